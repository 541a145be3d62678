"""Result records (nested JSON, one record per model run) and their scans.

Records are built from prediction tables by grouped aggregation (one row per
run), written with ``df.write.json`` and read back with an explicit nested
schema; a malformed record is kept in ``_corrupt_record`` by PERMISSIVE mode,
counted and skipped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aspectra import dicts
from aspectra.operators import matrices as MX
from aspectra.operators import metrics as M
from aspectra.sources.corpus import path_exists

D, S, L = T.DoubleType(), T.StringType(), T.LongType()
FOLD = T.StructType([T.StructField("fold", T.IntegerType()), T.StructField("f1_macro", D),
                     T.StructField("precision_macro", D), T.StructField("recall_macro", D)])
REPORT = T.StructType([T.StructField("precision", D), T.StructField("recall", D),
                       T.StructField("f1-score", D), T.StructField("support", D)])
SVM_RESULT = T.StructType([
    T.StructField("fold_results", T.ArrayType(FOLD)),
    T.StructField("global_f1_macro", D), T.StructField("global_precision_macro", D),
    T.StructField("global_recall_macro", D),
    T.StructField("classification_report", T.MapType(S, REPORT)),
    T.StructField("confusion_matrix", T.ArrayType(T.ArrayType(L))),
    T.StructField("n_samples", L), T.StructField("lang", S), T.StructField("aspect", S),
    T.StructField("_corrupt_record", S),
])
GLOBAL = T.StructType([T.StructField("f1_macro", D), T.StructField("precision_macro", D),
                       T.StructField("recall_macro", D), T.StructField("accuracy", D),
                       T.StructField("n_test", L)])
MODEL_RESULT = T.StructType([
    T.StructField("model_name", S), T.StructField("lang", S),
    T.StructField("global", GLOBAL),
    T.StructField("global_f1_macro", D), T.StructField("global_precision_macro", D),
    T.StructField("global_recall_macro", D), T.StructField("n_samples", L),
    T.StructField("per_aspect", T.MapType(S, D)),
    T.StructField("n_train", L), T.StructField("n_val", L), T.StructField("n_test", L),
    T.StructField("timestamp", S),
    T.StructField("_corrupt_record", S),
])


# ---------------------------------------------------------------------------
# Building records
# ---------------------------------------------------------------------------

def svm_result_records(preds: DataFrame, keys=("lang", "aspect"), fold: str = "fold",
                       labels=dicts.POLARITIES) -> DataFrame:
    """One record per group: per-fold metrics, pooled metrics, report map,
    confusion matrix (rows = true label, columns = predicted, label order),
    n.  Every nested collection is bounded (folds, labels)."""
    keys = list(keys)
    c = M.pair_counts(preds, keys + [fold])
    per_fold = M.macro_from_stats(M.label_stats(c, keys + [fold]), keys + [fold])
    folds = per_fold.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(
        F.col(fold).cast("int").alias("fold"), "f1_macro", "precision_macro", "recall_macro"))).alias("fold_results"))
    pooled_c = c.groupBy(*keys, "y_true", "y_pred").agg(F.sum("n").alias("n"))
    st = M.label_stats(pooled_c, keys)
    pooled = M.macro_from_stats(st, keys).select(
        *keys, F.col("f1_macro").alias("global_f1_macro"),
        F.col("precision_macro").alias("global_precision_macro"),
        F.col("recall_macro").alias("global_recall_macro"), "n_samples")
    report = st.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(
        "label", F.struct(F.bround("precision", 6).alias("precision"), F.bround("recall", 6).alias("recall"),
                          F.bround("f1", 6).alias("f1-score"), F.col("support").cast("double").alias("support")))
    )).alias("classification_report"))
    lab = dicts.array_literal(labels)
    cells = pooled_c.groupBy(*keys, "y_true").agg(F.map_from_entries(F.collect_list(F.struct("y_pred", "n"))).alias("m"))
    rows = cells.select(*keys, "y_true", F.transform(lab, lambda p: F.coalesce(F.col("m")[p], F.lit(0))).alias("row"))
    cm = rows.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("y_true", "row"))).alias("mm"))
    cm = cm.select(*keys, F.transform(lab, lambda t: F.coalesce(
        F.col("mm")[t], F.array_repeat(F.lit(0).cast("bigint"), len(labels)))).alias("confusion_matrix"))
    return folds.join(pooled, keys).join(report, keys).join(cm, keys)


def model_result_records(preds: DataFrame, nested: bool = True) -> DataFrame:
    """One record per (model, lang): overall metrics and per-aspect F1 map.
    ``nested`` writes them under ``global`` (newer layout), else as root keys."""
    overall = M.macro_metrics(preds, ["model", "lang"])
    per_aspect = M.macro_metrics(preds, ["model", "lang", "aspect"]) \
        .groupBy("model", "lang").agg(F.map_from_entries(F.collect_list(F.struct("aspect", "f1_macro"))).alias("per_aspect"))
    r = overall.join(per_aspect, ["model", "lang"])
    if nested:
        return r.select(F.col("model").alias("model_name"), "lang",
                        F.struct("f1_macro", "precision_macro", "recall_macro", "accuracy",
                                 F.col("n_samples").alias("n_test")).alias("global"), "per_aspect")
    return r.select(F.col("model").alias("model_name"), "lang",
                    F.col("f1_macro").alias("global_f1_macro"),
                    F.col("precision_macro").alias("global_precision_macro"),
                    F.col("recall_macro").alias("global_recall_macro"), "n_samples", "per_aspect")


def write_results(records: DataFrame, path: str, mode: str = "overwrite") -> str:
    records.write.mode(mode).json(path)
    return path


# ---------------------------------------------------------------------------
# Scans
# ---------------------------------------------------------------------------

def _read(spark: SparkSession, path, schema, multi_line: bool = False, observed: Observation | None = None) -> DataFrame:
    """The records; ``observed`` gets their number and that of malformed ones from the
    action that reads them, without a scan of its own."""
    df = (spark.read.schema(schema).option("mode", "PERMISSIVE")
          .option("columnNameOfCorruptRecord", "_corrupt_record")
          .option("multiLine", multi_line).json(path))
    df = df.withColumn("file", F.col("_metadata.file_path"))
    if observed is not None:
        df = df.observe(observed, F.count(F.lit(1)).alias("records"), F.count_if(F.col("_corrupt_record").isNotNull()).alias("malformed"))
    return df


def _valid(df: DataFrame, probe: str = "lang") -> DataFrame:
    """Rows without a corrupt record.  The condition equals
    ``_corrupt_record IS NULL`` (the first disjunct implies the second) but
    also references a data column: Spark refuses scans whose only required
    column is the corrupt-record column, which is what ``count()`` would
    otherwise leave after pruning."""
    c = F.col("_corrupt_record")
    return df.filter(F.coalesce(c, F.col(probe)).isNull() | c.isNull())


def corrupt_count(df: DataFrame) -> DataFrame:
    """Number of malformed records.  Spark refuses queries that read only the
    corrupt-record column from raw files, so the parsed records (one small
    row per model run) are cached first, as Spark recommends."""
    return df.cache().agg(F.count_if(F.col("_corrupt_record").isNotNull()).alias("n_corrupt"))


def scan_svm_metrics(spark: SparkSession, path, multi_line: bool = False, observed: Observation | None = None) -> DataFrame:
    """Baseline result records -> METRIC rows (defaults for missing keys,
    rounded to 4 half-even)."""
    d = _valid(_read(spark, path, SVM_RESULT, multi_line, observed))
    return d.select(F.lit(dicts.BASELINE_MODEL).alias("model"),
                    F.coalesce("lang", F.lit("?")).alias("lang"), "aspect",
                    F.bround(F.coalesce("global_f1_macro", F.lit(0.0)), 4).alias("f1_macro"),
                    F.bround(F.coalesce("global_precision_macro", F.lit(0.0)), 4).alias("precision_macro"),
                    F.bround(F.coalesce("global_recall_macro", F.lit(0.0)), 4).alias("recall_macro"),
                    F.coalesce("n_samples", F.lit(0)).cast("bigint").alias("n_samples"))


def scan_model_metrics(spark: SparkSession, path, multi_line: bool = False, observed: Observation | None = None) -> DataFrame:
    """Model result records in either layout -> one overall METRIC row plus
    one row per entry of ``per_aspect``."""
    d = _valid(_read(spark, path, MODEL_RESULT, multi_line, observed))
    nested = F.col("global").isNotNull()
    f1 = F.when(nested, F.col("global.f1_macro")).otherwise(F.col("global_f1_macro"))
    pr = F.when(nested, F.col("global.precision_macro")).otherwise(F.col("global_precision_macro"))
    rc = F.when(nested, F.col("global.recall_macro")).otherwise(F.col("global_recall_macro"))
    n = F.when(nested, F.col("global.n_test")).otherwise(F.col("n_samples"))
    base = d.select(F.coalesce("model_name", F.lit("unknown")).alias("model"),
                    F.coalesce("lang", F.lit("?")).alias("lang"),
                    F.bround(F.coalesce(f1, F.lit(0.0)), 4).alias("f1_macro"),
                    F.bround(F.coalesce(pr, F.lit(0.0)), 4).alias("precision_macro"),
                    F.bround(F.coalesce(rc, F.lit(0.0)), 4).alias("recall_macro"),
                    F.coalesce(n, F.lit(0)).cast("bigint").alias("n_samples"), "per_aspect")
    overall = base.select("model", "lang", F.lit(None).cast("string").alias("aspect"), "f1_macro",
                          "precision_macro", "recall_macro", "n_samples")
    asp = base.select("model", "lang", F.explode(F.map_entries(F.coalesce(
        "per_aspect", F.create_map().cast("map<string,double>")))).alias("e"))
    asp = asp.select("model", "lang", F.col("e.key").alias("aspect"),
                     F.bround(F.col("e.value"), 4).alias("f1_macro"),
                     F.lit(None).cast("double").alias("precision_macro"),
                     F.lit(None).cast("double").alias("recall_macro"),
                     F.lit(None).cast("bigint").alias("n_samples"))
    return overall.unionByName(asp)


def scan_all_metrics(spark: SparkSession, svm_path, *model_paths) -> DataFrame:
    """Result files of all families consolidated into METRIC (display name and family)."""
    models = scan_model_metrics(spark, model_paths[0])
    for path in model_paths[1:]:
        models = models.unionByName(scan_model_metrics(spark, path))
    return MX.consolidate_metrics(scan_svm_metrics(spark, svm_path), models)


def _stem(family: str, otherwise: Column) -> Column:
    """What a result file's name says after ``<family>_results_``; files that Spark wrote
    are named by their record instead."""
    name = F.element_at(F.split("file", "/"), -1)
    own = F.regexp_replace(name, rf"^({family}_results_)?(.*)\.json$", "$2")
    return F.when(name.startswith("part-"), otherwise).otherwise(own)


def scan_results(spark: SparkSession, root: str) -> DataFrame:
    """All result records under ``root/<family>_results/`` of the families that have a
    folder, as comparison rows: name ``<family>_<file stem>``, lang ('N/A' if missing),
    F1, precision, recall (0 if missing), n, model name."""
    parts = []
    if path_exists(spark, f"{root}/svm_results"):
        svm = _valid(_read(spark, f"{root}/svm_results", SVM_RESULT))
        record = F.concat_ws("_", F.coalesce("lang", F.lit("")), F.coalesce("aspect", F.lit("")))
        parts.append(svm.select(F.lit("svm").alias("family"), _stem("svm", record).alias("stem"), "lang", "global_f1_macro",
                                "global_precision_macro", "global_recall_macro", "n_samples", F.lit("").alias("model_name")))
    for family in ("transformer", "emotion"):
        if not path_exists(spark, f"{root}/{family}_results"):
            continue
        mod = _valid(_read(spark, f"{root}/{family}_results", MODEL_RESULT))
        record = F.concat_ws("_", F.regexp_replace(F.coalesce("model_name", F.lit("")), "/", "_"), F.coalesce("lang", F.lit("")))

        def either(nested: str, flat: str) -> Column:
            return F.when(F.col("global").isNotNull(), F.col(f"global.{nested}")).otherwise(F.col(flat)).alias(flat)

        parts.append(mod.select(F.lit(family).alias("family"), _stem(family, record).alias("stem"), "lang", either("f1_macro", "global_f1_macro"),
                                either("precision_macro", "global_precision_macro"), either("recall_macro", "global_recall_macro"),
                                either("n_test", "n_samples"), F.coalesce("model_name", F.lit("")).alias("model_name")))
    if not parts:
        raise FileNotFoundError(f"no result folder below {root}")
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    return u.select(F.concat_ws("_", "family", "stem").alias("name"),
                    F.coalesce("lang", F.lit("N/A")).alias("lang"),
                    F.coalesce("global_f1_macro", F.lit(0.0)).alias("macro_f1"),
                    F.coalesce("global_precision_macro", F.lit(0.0)).alias("precision"),
                    F.coalesce("global_recall_macro", F.lit(0.0)).alias("recall"),
                    F.coalesce("n_samples", F.lit(0)).cast("bigint").alias("n_samples"),
                    "model_name", "family")
