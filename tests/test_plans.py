"""Plan properties that matter at scale, asserted on the physical plans."""
import re

from conftest import SF001


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def q(spark, name):
    import __spark_entry__ as E
    return E.queries()[name](spark, SF001)


def test_flagship_one_shuffle_no_python(spark):
    p = plan_of(q(spark, "aspect_sentiment_emotion_matrix"))
    assert len(re.findall(r"Exchange hashpartitioning", p)) == 1
    assert "ArrowEvalPython" not in p and "BatchEvalPython" not in p
    # column pruning: the documents scan reads only what the rules use
    assert re.search(r"ReadSchema: struct<doc_id:bigint,text:string>", p)


def test_text_normalisation_stays_in_jvm(spark):
    p = plan_of(q(spark, "normalize_text"))
    assert "ArrowEvalPython" not in p and "BatchEvalPython" not in p
    assert "reflect" in p.lower() or "CallMethodViaReflection" in p or "invoke" in p.lower()


def test_metrics_single_scan_of_predictions(spark):
    p = plan_of(q(spark, "macro_metrics"))
    assert len(re.findall(r"FileScan parquet", p)) == 1


def test_partition_pruning_on_lang(spark):
    p = plan_of(q(spark, "scan_corpus").filter("lang = 'fr'"))
    assert re.search(r"PartitionFilters: \[[^\]]*lang", p)


def test_matrix_pivots_are_single_aggregations(spark):
    p = plan_of(q(spark, "crosstab_lang_polarity"))
    assert len(re.findall(r"Exchange hashpartitioning", p)) == 1


def test_tfidf_vocabulary_is_broadcast(spark):
    p = plan_of(q(spark, "tfidf_terms"))
    assert "BroadcastHashJoin" in p and "SortMergeJoin" not in p
