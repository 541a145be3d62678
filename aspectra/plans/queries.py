"""Registered queries: one per operator of the inventory.

Each takes ``(spark, sf_dir)``, reads the driver tables (or data Spark derives
from them) and returns a lazy DataFrame whose column names equal those of the
matching oracle SQL in ``aspectra.plans.oracle``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aspectra import dicts
from aspectra import fixtures as fx
from aspectra.functions import labels as L
from aspectra.functions import text as T
from aspectra.operators import emotions as E
from aspectra.operators import labeling as LB

QUERIES: dict = {}


def query(name):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def corpus(spark: SparkSession, sf: str, terms=dicts.ASPECT_TERMS) -> DataFrame:
    """Fixture reviews with normalised polarity and mapped aspect."""
    return (fx.reviews(spark, sf)
            .transform(LB.normalize_polarity, col="polarity_raw", out="polarity")
            .transform(LB.map_aspects, col="aspect_raw", terms=terms, out="aspect")
            .select("review_id", "lang", "text", "aspect", "polarity"))


# --------------------------------------------------------------------------
# Flagship: reviews -> polarity -> aspects -> keyword emotion -> matrix
# --------------------------------------------------------------------------

@query("aspect_sentiment_emotion_matrix")
def q_aspect_sentiment_emotion_matrix(spark, sf):
    return (corpus(spark, sf)
            .transform(E.keyword_emotion)
            .transform(E.aspect_sentiment_emotion_matrix))


# --------------------------------------------------------------------------
# 2.3 projections / filters
# --------------------------------------------------------------------------

@query("normalize_polarity")
def q_normalize_polarity(spark, sf):
    return (fx.reviews(spark, sf)
            .transform(LB.normalize_polarity, col="polarity_raw", strip=True, out="polarity")
            .select("review_id", "polarity"))


@query("normalize_target")
def q_normalize_target(spark, sf):
    return fx.reviews(spark, sf).select("review_id", L.normalize_target("aspect_raw").alias("aspect"))


@query("map_aspects")
def q_map_aspects(spark, sf):
    return (fx.reviews(spark, sf)
            .transform(LB.map_aspects, col="aspect_raw", out="aspect")
            .select("review_id", "lang", "aspect"))


@query("map_aspects_small")
def q_map_aspects_small(spark, sf):
    return (fx.reviews(spark, sf)
            .transform(LB.map_aspects, col="aspect_raw", terms=dicts.ASPECT_TERMS_SMALL, out="aspect")
            .groupBy("lang", "aspect").agg(F.count(F.lit(1)).alias("n")))


@query("mapping_coverage")
def q_mapping_coverage(spark, sf):
    return LB.mapping_coverage(fx.reviews(spark, sf), col="aspect_raw", by=["lang"])


@query("absa_input")
def q_absa_input(spark, sf):
    return corpus(spark, sf).transform(LB.add_absa_input).select("review_id", "absa_input")


@query("aspect_tagged_text")
def q_aspect_tagged_text(spark, sf):
    df = corpus(spark, sf).withColumn("text_processed", T.normalize_text("text", "lang"))
    return df.transform(LB.add_aspect_tagged_text).select("review_id", "model_text")


@query("encode_polarity")
def q_encode_polarity(spark, sf):
    df = corpus(spark, sf)
    return df.select("review_id",
                     L.encode_polarity("polarity").alias("label"),
                     L.encode_polarity("polarity", dicts.POLARITY_CODES_ALT).alias("label_alt"))


@query("encode_emotion")
def q_encode_emotion(spark, sf):
    df = corpus(spark, sf).transform(E.keyword_emotion)
    return df.transform(LB.encode_emotion).select("review_id", "emotion", "label")


@query("choose_model_text")
def q_choose_model_text(spark, sf):
    return corpus(spark, sf).transform(LB.add_absa_input).transform(LB.choose_model_text) \
                            .select("review_id", "model_input")


@query("filter_lang_aspect")
def q_filter_lang_aspect(spark, sf):
    return corpus(spark, sf).transform(LB.filter_lang_aspect, lang="fr", aspect="service") \
                            .select("review_id", "lang", "aspect", "polarity")


@query("drop_aspect")
def q_drop_aspect(spark, sf):
    return corpus(spark, sf).transform(LB.drop_aspect).select("review_id", "lang", "polarity")


@query("drop_empty_text")
def q_drop_empty_text(spark, sf):
    df = corpus(spark, sf).withColumn("text_processed", T.normalize_text("text", "lang"))
    return df.transform(LB.drop_empty_text).select("review_id", "text_processed")


@query("data_gates")
def q_data_gates(spark, sf):
    return LB.data_gates(corpus(spark, sf))


# --------------------------------------------------------------------------
# 2.9 string functions and preprocessing
# --------------------------------------------------------------------------

from aspectra.operators import counts as C  # noqa: E402
from aspectra.operators import preprocess as P  # noqa: E402

RAW_MODEL_LABELS = ["joy", "love", "optimism", "neutral", "surprise", "anger",
                    "disgust", "fear", "sadness", "UNKNOWN", None, "Sadness"]


@query("strip_accents")
def q_strip_accents(spark, sf):
    r = fx.reviews(spark, sf).filter(F.col("lang") == "en")
    return r.select("review_id", T.strip_accents(F.lower("text")).alias("text_out"))


@query("remove_urls")
def q_remove_urls(spark, sf):
    return fx.reviews(spark, sf).select("review_id", T.remove_urls("text").alias("text_out"))


@query("remove_mentions_hashtags")
def q_remove_mentions_hashtags(spark, sf):
    return fx.reviews(spark, sf).select("review_id", T.remove_mentions_hashtags("text").alias("text_out"))


@query("remove_punctuation")
def q_remove_punctuation(spark, sf):
    return fx.reviews(spark, sf).select("review_id", T.remove_punctuation("text", "lang").alias("text_out"))


@query("remove_digits")
def q_remove_digits(spark, sf):
    return fx.reviews(spark, sf).select("review_id", T.remove_digits("text", "lang").alias("text_out"))


@query("collapse_whitespace")
def q_collapse_whitespace(spark, sf):
    return fx.reviews(spark, sf).select("review_id", T.collapse_whitespace("text").alias("text_out"))


@query("normalize_text")
def q_normalize_text(spark, sf):
    return fx.reviews(spark, sf).select("review_id", "lang",
                                        T.normalize_text("text", "lang").alias("text_processed"))


@query("remove_stopwords")
def q_remove_stopwords(spark, sf):
    r = fx.reviews(spark, sf).withColumn("t", T.normalize_text("text", "lang"))
    return r.select("review_id", T.remove_stopwords("t", "lang", dicts.STOPWORDS).alias("text_out"))


@query("lemma_lookup")
def q_lemma_lookup(spark, sf):
    r = fx.reviews(spark, sf).withColumn("text_processed", T.normalize_text("text", "lang"))
    return (P.lemma_lookup(r, fx.lemma_frame(spark), out="text_out")
            .select("review_id", "text_out"))


@query("preprocess_classic")
def q_preprocess_classic(spark, sf):
    return (P.preprocess_classic(corpus(spark, sf), lemmas=fx.lemma_frame(spark))
            .select("review_id", "lang", "polarity", "text_processed"))


@query("preprocess_light")
def q_preprocess_light(spark, sf):
    return P.preprocess_light(corpus(spark, sf)).select("review_id", "lang", "text_processed")


@query("texts_labels_by_lang")
def q_texts_labels_by_lang(spark, sf):
    return P.texts_labels_by_lang(P.preprocess_classic(corpus(spark, sf)))


@query("keyword_emotion")
def q_keyword_emotion(spark, sf):
    return corpus(spark, sf).transform(E.keyword_emotion).select("review_id", "emotion")


@query("keyword_emotion_short")
def q_keyword_emotion_short(spark, sf):
    return corpus(spark, sf).transform(E.keyword_emotion_short).select("review_id", "emotion")


@query("map_model_label")
def q_map_model_label(spark, sf):
    df = corpus(spark, sf).withColumn(
        "raw_label", fx._pick(RAW_MODEL_LABELS, F.col("review_id") % len(RAW_MODEL_LABELS) + 1))
    return df.select("review_id", L.map_model_label("raw_label", "text", "polarity").alias("emotion"))


@query("label_emotions_silver")
def q_label_emotions_silver(spark, sf):
    return E.label_emotions_silver(corpus(spark, sf)).select("review_id", "emotion")


# --------------------------------------------------------------------------
# 2.5 counts, 2.8 set operations
# --------------------------------------------------------------------------

def corpus_emotion(spark, sf):
    return corpus(spark, sf).transform(E.keyword_emotion)


@query("value_counts")
def q_value_counts(spark, sf):
    return C.value_counts(corpus_emotion(spark, sf))


@query("crosstab_lang_polarity")
def q_crosstab_lang_polarity(spark, sf):
    return C.crosstab_lang_polarity(corpus(spark, sf))


@query("crosstab_lang_aspect")
def q_crosstab_lang_aspect(spark, sf):
    return C.crosstab_lang_aspect(corpus(spark, sf))


@query("missing_classes")
def q_missing_classes(spark, sf):
    return E.missing_classes(corpus_emotion(spark, sf), by=["lang"])


def conversation_reviews(spark, sf):
    """A second review source: conversation turns as whole-text opinions
    (aspect 'general', polarity 'neutral', language English)."""
    c = fx.table(spark, sf, "conversations")
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("review_id"),
                    F.lit("en").alias("lang"), "text",
                    F.lit("general").alias("aspect"), F.lit("neutral").alias("polarity"))


@query("union_corpora")
def q_union_corpora(spark, sf):
    a = fx.reviews(spark, sf).transform(LB.normalize_polarity, col="polarity_raw", out="polarity") \
          .select("review_id", "lang", "text", L.normalize_target("aspect_raw").alias("aspect"), "polarity")
    b = conversation_reviews(spark, sf)
    u = a.withColumn("source", F.lit("documents")).unionByName(b.withColumn("source", F.lit("conversations")))
    return u.select("source", "review_id", "lang", "aspect", "polarity")


# --------------------------------------------------------------------------
# 2.6 windows: sampling, quotas, splits, folds; 2.10 augmentation
# --------------------------------------------------------------------------

from aspectra.operators import augment as AU  # noqa: E402
from aspectra.operators import cleaning as CL  # noqa: E402
from aspectra.operators import metrics as M  # noqa: E402
from aspectra.operators import sampling as SA  # noqa: E402


def polarity_reviews(spark, sf):
    """All fixture reviews with a valid polarity (aspects not yet mapped)."""
    return (fx.reviews(spark, sf)
            .transform(LB.normalize_polarity, col="polarity_raw", out="polarity")
            .select("review_id", "lang", "text", "aspect_raw", "polarity"))


@query("sample_per_lang")
def q_sample_per_lang(spark, sf):
    return SA.sample_per_lang(polarity_reviews(spark, sf)).select("review_id", "lang")


@query("sample_per_lang_100")
def q_sample_per_lang_100(spark, sf):
    return SA.sample_per_lang(polarity_reviews(spark, sf), n=100).select("review_id", "lang")


@query("balance_corpus")
def q_balance_corpus(spark, sf):
    return SA.balance_corpus(corpus(spark, sf)).select("review_id", "lang", "polarity")


@query("balance_corpus_100")
def q_balance_corpus_100(spark, sf):
    return SA.balance_corpus(corpus(spark, sf), target_per_lang=100).select("review_id", "lang", "polarity")


@query("balance_shortfall")
def q_balance_shortfall(spark, sf):
    return SA.balance_shortfall(corpus(spark, sf))


@query("split_train_val_test")
def q_split_train_val_test(spark, sf):
    return SA.split_train_val_test(corpus(spark, sf)).select("review_id", "polarity", "split")


@query("stratified_kfold")
def q_stratified_kfold(spark, sf):
    return SA.stratified_kfold(corpus(spark, sf)).select("review_id", "polarity", "fold")


def light_corpus(spark, sf):
    return P.preprocess_light(corpus(spark, sf))


AUG_SYNONYMS = dicts.SYNONYMS + fx.EN_SYNONYMS


@query("augment_size")
def q_augment_size(spark, sf):
    return AU.augment_size(light_corpus(spark, sf))


@query("augment_class")
def q_augment_class(spark, sf):
    # sized, numbered and drawn from: made once
    g = AU.augment_class(cut_lineage(light_corpus(spark, sf)), synonyms=AUG_SYNONYMS)
    return g.select("aug_id", "review_id", "lang", "polarity", "text", "text_processed")


@query("replace_synonyms")
def q_replace_synonyms(spark, sf):
    d = light_corpus(spark, sf)
    return d.select("review_id", AU.replace_synonyms("text_processed", "lang", "review_id",
                                                     AUG_SYNONYMS).alias("text_out"))


@query("balanced_union")
def q_balanced_union(spark, sf):
    d = cut_lineage(light_corpus(spark, sf))         # one side of the union, source of the other
    u = AU.balanced_union(d, AU.augment_class(d, synonyms=AUG_SYNONYMS))
    return u.groupBy("polarity", F.col("aug_id").isNotNull().alias("generated")) \
            .agg(F.count(F.lit(1)).alias("n"))


# --------------------------------------------------------------------------
# 2.5 metrics on the prediction fixture (lineitem scale)
# --------------------------------------------------------------------------

def preds(spark, sf):
    return fx.predictions(spark, sf)


@query("confusion_matrix")
def q_confusion_matrix(spark, sf):
    return M.confusion_matrix(preds(spark, sf), keys=["model"])


@query("classification_report")
def q_classification_report(spark, sf):
    return M.classification_report(preds(spark, sf), keys=["model"])


@query("macro_metrics")
def q_macro_metrics(spark, sf):
    return M.macro_metrics(preds(spark, sf), keys=["model", "lang", "aspect"])


def preds_with_folds(spark, sf):
    return SA.stratified_kfold(preds(spark, sf), label="y_true", id_col="row_id",
                               strata_extra=["model"])


@query("fold_metrics")
def q_fold_metrics(spark, sf):
    return M.fold_metrics(preds_with_folds(spark, sf), keys=["model"])


@query("class_weights")
def q_class_weights(spark, sf):
    return M.class_weights(corpus(spark, sf), label="polarity")


@query("grid_summary")
def q_grid_summary(spark, sf):
    p = preds(spark, sf).filter(F.col("model") == "SVM")
    p = p.withColumn("lang", F.explode(F.array(F.col("lang"), F.lit("all"))))
    return M.macro_metrics(p, keys=["lang", "aspect"]).drop("accuracy")


# --------------------------------------------------------------------------
# METRIC table and comparison matrices (2.1 end, 2.4, 2.5, 2.6, 2.7)
# --------------------------------------------------------------------------

from aspectra.operators import matrices as MX  # noqa: E402


def metric(spark, sf):
    p = preds(spark, sf)
    return MX.metric_table(p, fx.eval_lang(F.col("model"), F.col("lang")))


METRIC_COLS = ["model", "model_short", "family", "lang", "aspect", "f1_macro",
               "precision_macro", "recall_macro", "n_samples"]


@query("consolidate_metrics")
def q_consolidate_metrics(spark, sf):
    m = metric(spark, sf)
    svm = m.filter(F.col("model") == "SVM").drop("model_short", "family")
    other = m.filter(F.col("model") != "SVM").drop("family")
    return MX.consolidate_metrics(svm, other).select(*METRIC_COLS)


@query("global_matrix")
def q_global_matrix(spark, sf):
    return MX.global_matrix(metric(spark, sf))


@query("expand_all_lang")
def q_expand_all_lang(spark, sf):
    m = metric(spark, sf).filter(F.col("aspect").isNotNull())
    return MX.expand_all_lang(m).select("model_short", "lang", "aspect", "f1_macro")


@query("absa_matrix")
def q_absa_matrix(spark, sf):
    return MX.absa_matrix(metric(spark, sf))


@query("gain_vs_baseline")
def q_gain_vs_baseline(spark, sf):
    return MX.gain_vs_baseline(metric(spark, sf))


def comparison(spark, sf):
    return MX.comparison_table(metric(spark, sf))


@query("comparison_table")
def q_comparison_table(spark, sf):
    return comparison(spark, sf)


@query("best_model")
def q_best_model(spark, sf):
    return MX.best_model(comparison(spark, sf))


@query("family_summary")
def q_family_summary(spark, sf):
    return MX.family_summary(comparison(spark, sf))


@query("best_per_lang")
def q_best_per_lang(spark, sf):
    return MX.best_per_lang(comparison(spark, sf))


@query("evaluation_report")
def q_evaluation_report(spark, sf):
    return MX.evaluation_report(comparison(spark, sf))


# --------------------------------------------------------------------------
# 2.7 / 2.10 TF-IDF
# --------------------------------------------------------------------------

from aspectra.operators import features as FE  # noqa: E402


def classic_corpus(spark, sf):
    return P.preprocess_classic(corpus(spark, sf), lemmas=fx.lemma_frame(spark))


@query("tfidf_terms")
def q_tfidf_terms(spark, sf):
    return FE.tfidf_terms(classic_corpus(spark, sf))


@query("vocabulary_topk")
def q_vocabulary_topk(spark, sf):
    return FE.vocabulary_topk(classic_corpus(spark, sf))


# --------------------------------------------------------------------------
# 2.1 sources and 2.2 sinks (files derived from the tables by Spark)
# --------------------------------------------------------------------------

from aspectra.plans import derived as DV  # noqa: E402
from aspectra.session import cut_lineage, scratch_path  # noqa: E402
from aspectra.sources import corpus as SC  # noqa: E402
from aspectra.sources import csv as SCSV  # noqa: E402
from aspectra.sources import results as SR  # noqa: E402
from aspectra.sources import routing as SRT  # noqa: E402
from aspectra.sources import xml as SX  # noqa: E402

REVIEW_OUT = ["text", "aspect", "polarity", "lang"]


@query("read_opinion_xml")
def q_read_opinion_xml(spark, sf):
    return SX.read_opinion_xml(spark, DV.opinion_xml(spark, sf)).select(*REVIEW_OUT)


@query("whole_text_fallback")
def q_whole_text_fallback(spark, sf):
    s = SX.read_sentences(spark, DV.opinion_xml(spark, sf))
    return SX.whole_text_fallback(s, SX.opinion_entries(), "fr").select(*REVIEW_OUT)


@query("read_aspect_term_xml")
def q_read_aspect_term_xml(spark, sf):
    return SX.read_aspect_term_xml(spark, DV.term_xml(spark, sf)).select(*REVIEW_OUT)


@query("route_inputs")
def q_route_inputs(spark, sf):
    root = scratch_path(spark, "raw")
    DV.opinion_xml(spark, sf, f"{root}/opinions")
    DV.term_xml(spark, sf, f"{root}/terms")
    DV.labelled_csv(spark, sf, f"{root}/labelled")
    return SRT.route_inputs(spark, root).select(*REVIEW_OUT)


@query("read_labelled_csv")
def q_read_labelled_csv(spark, sf):
    return SCSV.read_labelled_csv(spark, DV.labelled_csv(spark, sf)).select(*REVIEW_OUT)


@query("read_labelled_csv_encodings")
def q_read_labelled_csv_encodings(spark, sf):
    return SCSV.read_labelled_csv(spark, DV.mixed_csv(spark, sf), encoding=SCSV.ENCODINGS).select(*REVIEW_OUT)


@query("detect_columns")
def q_detect_columns(spark, sf):
    raw = SCSV.read_csv_raw(spark, DV.labelled_csv(spark, sf))
    t, lab = SCSV.detect_columns(raw.columns)
    # schema-level decision; returned as a one-row frame of the chosen names
    return raw.limit(1).select(F.lit(t).alias("text_col"), F.lit(lab).alias("label_col"))


@query("write_corpus")
def q_write_corpus(spark, sf):
    path = SC.write_corpus(corpus(spark, sf), scratch_path(spark, "corpus"))
    return spark.read.parquet(path).select("review_id", "lang", "text", "aspect", "polarity")


@query("write_corpus_csv")
def q_write_corpus_csv(spark, sf):
    path = SC.write_corpus(corpus(spark, sf), scratch_path(spark, "corpus-csv"), fmt="csv")
    schema = "review_id bigint, text string, aspect string, polarity string"
    d = (spark.read.schema(schema).option("header", True).option("multiLine", True)
         .option("escape", '"').csv(path))
    return d.select("review_id", "lang", "text", "aspect", "polarity")


@query("scan_corpus")
def q_scan_corpus(spark, sf):
    path = SC.write_corpus(corpus(spark, sf), scratch_path(spark, "corpus"))
    return SC.scan_corpus(spark, path).select("review_id", "lang", "text", "aspect", "polarity")


@query("scan_first_available")
def q_scan_first_available(spark, sf):
    path = SC.write_corpus(corpus(spark, sf), scratch_path(spark, "corpus"))
    missing = scratch_path(spark, "absent")
    return SC.scan_first_available(spark, [missing, path]).select("review_id", "lang", "text", "aspect", "polarity")


def svm_records(spark, sf):
    p = preds(spark, sf).filter(F.col("model") == "SVM")
    p = p.withColumn("lang", F.explode(F.array(F.col("lang"), F.lit("all"))))
    p = SA.stratified_kfold(p, label="y_true", id_col="row_id", strata_extra=["lang", "aspect"])
    return SR.svm_result_records(p, ["lang", "aspect"])


def model_records(spark, sf, nested: bool):
    p = preds(spark, sf).filter(F.col("model") != "SVM")
    p = p.withColumn("lang", fx.eval_lang(F.col("model"), F.col("lang")))
    keep = F.col("model") != "DeepPavlov/rubert-base-cased"
    return SR.model_result_records(p.filter(keep if nested else ~keep), nested=nested)


def write_all_results(spark, sf):
    root = scratch_path(spark, "results")
    SR.write_results(svm_records(spark, sf), f"{root}/svm_results")
    SR.write_results(model_records(spark, sf, True), f"{root}/transformer_results", mode="overwrite")
    SR.write_results(model_records(spark, sf, False), f"{root}/transformer_results", mode="append")
    return root


@query("write_results")
def q_write_results(spark, sf):
    root = scratch_path(spark, "results")
    SR.write_results(svm_records(spark, sf), f"{root}/svm_results")
    d = spark.read.schema(SR.SVM_RESULT).json(f"{root}/svm_results")
    return d.select("lang", "aspect", "global_f1_macro", "global_precision_macro", "global_recall_macro",
                    "n_samples", F.size("fold_results").alias("n_folds"),
                    F.aggregate("confusion_matrix", F.lit(0).cast("bigint"),
                                lambda acc, r: acc + F.aggregate(r, F.lit(0).cast("bigint"), lambda a, x: a + x))
                    .alias("cm_total"),
                    F.col("classification_report")["pos"]["f1-score"].alias("report_pos_f1"))


@query("scan_svm_metrics")
def q_scan_svm_metrics(spark, sf):
    root = write_all_results(spark, sf)
    return SR.scan_svm_metrics(spark, f"{root}/svm_results")


@query("scan_model_metrics")
def q_scan_model_metrics(spark, sf):
    root = write_all_results(spark, sf)
    return SR.scan_model_metrics(spark, f"{root}/transformer_results")


@query("scan_results")
def q_scan_results(spark, sf):
    return SR.scan_results(spark, write_all_results(spark, sf))


@query("write_matrix")
def q_write_matrix(spark, sf):
    path = SC.write_matrix(MX.absa_matrix(metric(spark, sf)), scratch_path(spark, "matrix"))
    schema = "aspect string, " + ", ".join(f"`{c}` double" for c in MX.matrix_columns())
    return spark.read.schema(schema).option("header", True).csv(path)


# --------------------------------------------------------------------------
# 2.10 classifiers (rows-only checks; trained many-at-once)
# --------------------------------------------------------------------------

from aspectra.operators import models as MD  # noqa: E402


def training_rows(spark, sf):
    """Classic-preprocessed corpus as (row_id, lang, aspect, text, y_true)."""
    c = classic_corpus(spark, sf)
    return c.select(F.col("review_id").alias("row_id"), "lang", "aspect",
                    F.col("text_processed").alias("text"), F.col("polarity").alias("y_true"))


def svm_holdout(spark, sf):
    return MD.holdout_evaluate(training_rows(spark, sf), [], kind="svm")


@query("train_linear_svm")
def q_train_linear_svm(spark, sf):
    return svm_holdout(spark, sf)[0]


@query("svm_task_vocabulary")
def q_svm_task_vocabulary(spark, sf):
    """The 300 most frequent terms of every (language, aspect), with idf over all rows."""
    d = cut_lineage(training_rows(spark, sf).withColumn("task", MD._task_id(["lang", "aspect"])))    # for terms and sizes
    v = MD.task_vocabulary(d, max_features=300)
    return v.select("task", "term", "df", "cf", "n_task", F.bround("idf", 6).alias("idf"))


@query("cross_validate_svm")
def q_cross_validate_svm(spark, sf):
    pred, _ = MD.cross_validate(training_rows(spark, sf), [], final=False)
    return M.fold_metrics(pred)


@query("svm_grid")
def q_svm_grid(spark, sf):
    summary, _, _ = MD.svm_grid(training_rows(spark, sf))
    return summary


def run_langs(df, runs=("fr", "all", "ru"), min_rows: int = 0):
    """Rows replicated into the runs they belong to (a language, or 'all')."""
    d = df.withColumn("run", F.explode(F.array(F.col("lang"), F.lit("all"))))
    d = d.filter(F.col("run").isin(list(runs)))
    if min_rows:
        ok = d.groupBy("run").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_rows).select("run")
        d = d.join(ok, "run")
    return d


def emotion_holdout(spark, sf):
    c = corpus(spark, sf).transform(E.keyword_emotion).transform(LB.add_absa_input) \
                         .transform(LB.choose_model_text)
    d = c.select(F.col("review_id").alias("row_id"), "lang", F.col("model_input").alias("text"),
                 F.col("emotion").alias("y_true"))
    d = run_langs(d, min_rows=dicts.MIN_ROWS_EMOTION)
    return MD.holdout_evaluate(d, ["run"], kind="logreg", labels=dicts.EMOTION_CODES)


@query("emotion_classifier")
def q_emotion_classifier(spark, sf):
    return emotion_holdout(spark, sf)[0]


def sentiment_holdout(spark, sf):
    c = P.preprocess_light(corpus(spark, sf)).transform(LB.add_aspect_tagged_text)
    d = c.select(F.col("review_id").alias("row_id"), "lang", F.col("model_text").alias("text"),
                 F.col("polarity").alias("y_true"))
    return MD.holdout_evaluate(run_langs(d), ["run"], kind="logreg")


@query("sentiment_classifier")
def q_sentiment_classifier(spark, sf):
    return sentiment_holdout(spark, sf)[0]


@query("classifier_facts")
def q_classifier_facts(spark, sf):
    """What doesn't depend on the fits: sizes of the parts, rows predicted, and the
    accuracy that always naming the largest class would have on the test rows."""
    def facts(name, met, pred):
        largest = pred.groupBy("run", "y_true").count().groupBy("run").agg(F.max("count").alias("_n"))
        return met.join(largest, "run").select(F.lit(name).alias("classifier"), "run", "n_train", "n_val", "n_test", F.col("n_samples").alias("n_predicted"),
                                               F.bround(F.col("_n") / F.col("n_samples"), 6).alias("majority_accuracy"))

    out = facts("svm", *svm_holdout(spark, sf))
    return out.union(facts("emotion", *emotion_holdout(spark, sf))).union(facts("sentiment", *sentiment_holdout(spark, sf)))


@query("save_classifier")
def q_save_classifier(spark, sf):
    """Predictions of the model that was written and read again."""
    d = cut_lineage(training_rows(spark, sf))        # fitted, then scored
    model = MD.fit_linear_svm(d.withColumn("task", F.lit("all")))
    path = model.save(scratch_path(spark, "svm-model"))
    loaded = MD.LinearModel.load(spark, path, model.tasks, model.labels)
    return loaded.transform(d.withColumn("task", F.lit("all"))).select("row_id", "y_true", "y_pred")


@query("tfidf_vectors")
def q_tfidf_vectors(spark, sf):
    """ML sparse vectors, exploded back to (id, term, weight): must equal the
    relational ``tfidf_terms`` weights."""
    d = classic_corpus(spark, sf)
    model, v = FE.tfidf_vectors(d)
    return FE.vector_terms(model, v, "review_id")


@query("write_report")
def q_write_report(spark, sf):
    """Report lines written as text and read back."""
    path = SC.write_report(MX.report_lines(MX.evaluation_report(comparison(spark, sf))),
                           scratch_path(spark, "report"))
    return spark.read.text(path).select(F.col("value").alias("line"))


# --------------------------------------------------------------------------
# the corpus chain, tables of synonyms, scored emotions, the whole report
# --------------------------------------------------------------------------

def raw_reviews(spark, sf):
    """Reviews with raw aspects and normalised polarity, as the chain takes them."""
    return (fx.reviews(spark, sf).transform(LB.normalize_polarity, col="polarity_raw", out="polarity")
            .select("review_id", "lang", "text", F.col("aspect_raw").alias("aspect"), "polarity"))


@query("build_clean_corpus")
def q_build_clean_corpus(spark, sf):
    d = CL.build_clean_corpus(raw_reviews(spark, sf), scratch_path(spark, "clean-corpus"))
    return d.select("review_id", "lang", "aspect", "polarity", "absa_input")


@query("language_gates")
def q_language_gates(spark, sf):
    return CL.language_gates(corpus(spark, sf), languages=[*dicts.LANGUAGES, "it"])


@query("emotion_input")
def q_emotion_input(spark, sf):
    d = corpus(spark, sf).withColumn("emotion", F.when(F.col("review_id") % 7 > 0, L.keyword_emotion("text", "polarity")))
    return CL.emotion_input(d, "en").select("review_id", "emotion", "label", "model_input")


def synonym_table(corpus):
    """A lexicon that grows with the corpus: two made-up forms of every word of four letters or more."""
    words = corpus.select("lang", F.explode(T.tokens("text_processed")).alias("word")).distinct().where("length(word) >= 4")
    return words.select("lang", "word", F.explode(F.array(F.concat("word", F.lit("s")), F.concat(F.lit("x"), "word"), "word")).alias("synonym"))


@query("replace_synonyms_from")
def q_replace_synonyms_from(spark, sf):
    d = cut_lineage(light_corpus(spark, sf).select("review_id", "lang", "text_processed"))    # read for words, draws and texts
    return AU.replace_synonyms_from(d, synonym_table(d)).select("review_id", "text_out")


@query("label_emotions_scored")
def q_label_emotions_scored(spark, sf):
    """The scorer path: a scorer that answers by the length of the text."""
    answers = list(RAW_MODEL_LABELS)

    def factory():
        return lambda texts: [answers[len(t) % len(answers)] for t in texts]

    return E.label_emotions_silver(corpus(spark, sf), factory).select("review_id", "emotion")


@query("texts_and_labels")
def q_texts_and_labels(spark, sf):
    path = P.write_texts_by_lang(P.preprocess_classic(corpus(spark, sf)), scratch_path(spark, "texts"))
    return spark.read.parquet(path).select("review_id", "lang", "text", "label")


@query("full_report")
def q_full_report(spark, sf):
    return MX.full_report(comparison(spark, sf))
