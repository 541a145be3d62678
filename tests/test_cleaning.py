"""The corpus chain, synonym tables, scorer batches, class gaps and the whole report."""
import os

import pytest
from pyspark.sql import functions as F

from aspectra.operators import augment as AU
from aspectra.operators import cleaning as CL
from aspectra.operators import emotions as E
from aspectra.operators import matrices as MX
from aspectra.operators import metrics as M
from aspectra.operators import preprocess as P

REVIEW = "review_id long, lang string, text string, aspect string, polarity string"


def reviews(spark, n=60):
    return spark.createDataFrame([(i, ["fr", "en", None][i % 3], None if i == 5 else f"t{i}", [" Prix ", "service", "zzz"][i % 3 if i % 5 else 0],
                                   ["pos", "neg", "neutral"][i // 3 % 3]) for i in range(n)], REVIEW)


def test_chain_publishes_the_quota(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "corpus")
    got = CL.build_clean_corpus(reviews(spark), path, target_per_lang=5).collect()
    n = {}
    for r in got:
        n[r.lang, r.polarity] = n.get((r.lang, r.polarity), 0) + 1
        assert r.absa_input == f"{r.aspect} : {r.text or ''}"
    assert n["fr", "pos"] == 2 and n["fr", "neg"] == 2 and n["fr", "neutral"] == 1


def test_chain_refuses_missing_columns_and_empty_results(spark, tmpdir_path):
    with pytest.raises(ValueError):
        CL.build_clean_corpus(reviews(spark).drop("lang"), os.path.join(tmpdir_path, "a"))
    path = os.path.join(tmpdir_path, "kept")
    CL.build_clean_corpus(reviews(spark), path)
    for bad in (reviews(spark).limit(0), reviews(spark).withColumn("aspect", F.lit("zzz")), reviews(spark).withColumn("polarity", F.lit("odd"))):
        with pytest.raises(RuntimeError):
            CL.build_clean_corpus(bad, path)
    assert spark.read.parquet(path).count() > 0         # the earlier corpus stays


def test_chain_without_aspects_and_with_extra_columns(spark, tmpdir_path):
    df = reviews(spark).drop("aspect").withColumn("quota", F.lit(1)).withColumn("absa_input", F.lit("x"))
    got = CL.build_clean_corpus(df.drop("quota"), os.path.join(tmpdir_path, "b"), target_per_lang=10).collect()
    assert got and all(r.absa_input == (r.text or "") for r in got)


def test_language_gates(spark):
    df = spark.createDataFrame([("ru", p) for p in ("pos", "neg")] * 40 + [("fr", "pos")] * 30 + [("en", "pos"), ("en", "neg")] * 15 + [(None, "pos")], "lang string, polarity string")
    got = {r.lang: (r.n_rows, r.status) for r in CL.language_gates(df, languages=["fr", "en", "ru", "it"]).collect()}
    assert got == {"ru": (80, "scarce"), "fr": (30, "single_class"), "en": (30, "ok"), "it": (0, "empty"), None: (1, "scarce")}
    assert {r.status for r in CL.language_gates(df.limit(0)).collect()} == {"empty"}


def test_emotion_column_is_reused_or_filled(spark):
    rows = [(i, "fr", "horrible" if i % 2 else None, "neg", ["joie", "odd", None][i % 3]) for i in range(30)]
    df = spark.createDataFrame(rows, "review_id long, lang string, text string, polarity string, emotion string")
    kept = CL.emotion_input(df, "fr").collect()
    assert len(kept) == 10 and {(r.emotion, r.label) for r in kept} == {("joie", 0)} and all(r.model_input in ("horrible", "") for r in kept)
    filled = CL.emotion_input(df.withColumn("emotion", F.lit(None).cast("string")), "fr")
    assert filled.count() == 30 and CL.emotion_input(df.drop("emotion")).count() == 30
    for lang in ("en", "fr"):
        with pytest.raises(ValueError):
            CL.emotion_input(df.limit(29), lang)


def test_synonym_table_equals_the_literal(spark):
    entries = [("fr", "bon", ["correct", "excellent"]), ("en", "good", ["fine", "great", "nice"])]
    table = spark.createDataFrame([(lang, w, a) for lang, w, alts in entries for a in alts]
                                  + [("fr", "bon", "bon"), ("fr", None, "x"), ("fr", "bon", None), ("en", "good", "fine")], "lang string, word string, synonym string")
    texts = [(i, ["fr", "en", None][i % 3], "bon good et bon " * (i % 9) + "bon") for i in range(60)]
    texts += [texts[4], (4, "fr", "bon bon"), (None, "fr", "bon bon bon"), (61, "fr", ""), (62, "fr", None), (63, "en", "good " * 5000 + "x")]
    df = spark.createDataFrame(texts, "review_id long, lang string, text_processed string").withColumn("word", F.lit("clash"))
    want = df.withColumn("text_out", AU.replace_synonyms("text_processed", "lang", "review_id", entries))
    got = AU.replace_synonyms_from(df, table)
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert sorted(map(str, AU.replace_synonyms_from(df, table.limit(0)).select("text_out").collect())) == sorted(map(str, df.select(F.col("text_processed").alias("text_out")).collect()))
    assert AU.replace_synonyms_from(df.limit(0), table).count() == 0


def test_short_batches_fall_back_alone(spark):
    df = spark.createDataFrame([(i, "horrible" if i == 3 else "nice", "neg") for i in range(20)], "i int, text string, polarity string").coalesce(1)

    def factory():
        return lambda texts: ["joy"] * (len(texts) - any("horrible" in t for t in texts))

    got = {r.i: r.emotion for r in E.label_emotions_silver(df, factory, batch_size=5).collect()}
    assert len(got) == 20 and got[3] == "colère" and got[0] == "insatisfaction" and got[10] == "joie"


def test_missing_classes(spark):
    df = spark.createDataFrame([("fr", "joie"), ("fr", "odd"), (None, "colère"), ("en", None)], "lang string, emotion string")
    assert {r.emotion for r in E.missing_classes(df).collect()} == {"satisfaction", "insatisfaction", "tristesse"}
    by = {(r.lang, r.emotion) for r in E.missing_classes(df, by=["lang"]).collect()}
    assert len(by) == 4 + 4 + 5 and ("fr", "joie") not in by and (None, "joie") in by
    assert E.missing_classes(df.limit(0)).count() == 5


def test_training_view_prunes_languages(spark, tmpdir_path):
    df = spark.createDataFrame([(1, "fr", "a b", "pos"), (2, "en", "c", None), (3, None, "d", "neg")], "review_id long, lang string, text_processed string, polarity string")
    back = spark.read.parquet(P.write_texts_by_lang(df, os.path.join(tmpdir_path, "t"))).select("review_id", "lang", "text", "label")
    assert sorted(map(tuple, back.collect())) == [(1, "fr", "a b", "pos"), (2, "en", "c", None), (3, None, "d", "neg")]
    assert [r.text for r in back.where("lang = 'fr'").collect()] == ["a b"]


def test_report_takes_one_scan(spark):
    df = spark.createDataFrame([("m", "pos", "pos"), ("m", "neg", "pos"), ("m", "macro avg", "odd")], "model string, y_true string, y_pred string")
    rep = M.classification_report(df, keys=["model"])
    got = sorted((r.label, r.precision, r.f1, r.support) for r in rep.where("label <> 'accuracy'").collect())
    assert [g[0] for g in got] == ["macro avg", "macro avg", "neg", "odd", "pos", "weighted avg"]
    assert rep._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1
    assert {r.label: r.f1 for r in rep.collect()}["accuracy"] == pytest.approx(0.333333)


def test_full_report_order(spark):
    rows = [("svm_a_fr", "fr", .5, .4, .6, 10, "a", "svm"), ("svm_b_N/A", "N/A", .7, .7, .7, 5, "b", "svm"), ("emotion_c_en", "en", .7, 0., 0., 0, "c", "emotion")]
    cmp = spark.createDataFrame(rows, "name string, lang string, macro_f1 double, precision double, recall double, n_samples long, model_name string, family string")
    got = MX.full_report(cmp)
    assert [r.section for r in got.collect()] == ["best_model"] + ["table"] * 3 + ["family_mean"] * 2 + ["family_best"] * 2
    lines = [r.value for r in MX.full_report_lines(got).collect()]
    assert lines[0] == "best_model | emotion | emotion_c_en | en | 0.7000 | 0.0000 | 0.0000 | 0"
    assert "family_mean | svm | - | - | 0.6000 | - | - | 2" in lines
    assert MX.full_report(cmp.limit(0)).count() == 0


def test_long_texts_get_their_synonyms_in_linear_time(spark):
    import time
    words = [f"w{i % 50}" for i in range(60_000)]
    df = spark.createDataFrame([(1, "en", " ".join(words))], "review_id long, lang string, text_processed string")
    table = spark.createDataFrame([("en", f"w{i}", f"{x}{i}") for i in range(49) for x in "ab"], "lang string, word string, synonym string")
    literal = [("en", f"w{i}", [f"a{i}", f"b{i}"]) for i in range(49)]
    want = df.select(AU.replace_synonyms("text_processed", "lang", "review_id", literal, prob=0.9)).first()[0]
    AU.replace_synonyms_from(df, table, prob=0.9).limit(0).collect()
    begin = time.perf_counter()
    got = AU.replace_synonyms_from(df, table, prob=0.9).select("text_out").first()[0]
    assert got == want and got != " ".join(words)
    assert time.perf_counter() - begin < 12
