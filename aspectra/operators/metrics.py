"""Classification metrics as grouped aggregations.

Everything starts from one small table — counts per (keys, y_true, y_pred),
whose partial aggregation happens map-side — so the prediction table is
scanned and shuffled once no matter how many metrics are derived.  Macro
averages run over the union of labels seen in y_true or y_pred, and a zero
denominator gives 0, as the classic definitions used by the original.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aspectra import dicts

R = 6  # decimals kept in derived ratios (half-even)


def _ratio(num, den):
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def pair_counts(df: DataFrame, keys=(), y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    return df.groupBy(*keys, F.col(y_true).alias("y_true"), F.col(y_pred).alias("y_pred")) \
             .agg(F.count(F.lit(1)).alias("n"))


def label_stats(counts: DataFrame, keys=()) -> DataFrame:
    """Per (keys, label): tp, support (true count), predicted count.  Each
    count row contributes to its true label and to its predicted label
    through one ``explode`` (a single pass, no union of two scans)."""
    keys = list(keys)
    n = F.col("n").cast("bigint")
    zero = F.lit(0).cast("bigint")
    tp = F.when(F.col("y_true") == F.col("y_pred"), n).otherwise(zero)
    sides = F.explode(F.array(
        F.struct(F.col("y_true").alias("label"), n.alias("support"), tp.alias("tp"), zero.alias("predicted")),
        F.struct(F.col("y_pred").alias("label"), zero.alias("support"), zero.alias("tp"), n.alias("predicted"))))
    s = counts.select(*keys, sides.alias("s")).select(*keys, "s.*").groupBy(*keys, "label").agg(
        F.sum("tp").alias("tp"), F.sum("support").alias("support"), F.sum("predicted").alias("predicted"))
    return (s.withColumn("precision", _ratio(F.col("tp"), F.col("predicted")))
             .withColumn("recall", _ratio(F.col("tp"), F.col("support")))
             .withColumn("f1", _ratio(2 * F.col("tp"), F.col("support") + F.col("predicted"))))


def macro_from_stats(stats: DataFrame, keys=()) -> DataFrame:
    return stats.groupBy(*keys).agg(
        F.bround(F.avg("f1"), R).alias("f1_macro"),
        F.bround(F.avg("precision"), R).alias("precision_macro"),
        F.bround(F.avg("recall"), R).alias("recall_macro"),
        F.bround(F.sum("tp") / F.sum("support"), R).alias("accuracy"),
        F.sum("support").alias("n_samples"))


def macro_metrics(df: DataFrame, keys=(), y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """Macro precision/recall/F1, accuracy and n per group."""
    return macro_from_stats(label_stats(pair_counts(df, keys, y_true, y_pred), keys), keys)


def classification_report(df: DataFrame, keys=(), y_true: str = "y_true",
                          y_pred: str = "y_pred") -> DataFrame:
    """Long report: one row per label, plus 'macro avg', 'weighted avg' and
    'accuracy' (f1 column holds the accuracy, precision/recall null)."""
    keys = list(keys)
    st = label_stats(pair_counts(df, keys, y_true, y_pred), keys)
    # every label feeds its own row and the three totals: one aggregation, no second scan
    kinds = F.array(F.struct(F.lit("label").alias("kind"), F.col("label")),
                    *[F.struct(F.lit(k).alias("kind"), F.lit(k).alias("label")) for k in ("macro avg", "weighted avg", "accuracy")])
    rows = st.select(*keys, "precision", "recall", "f1", "support", "tp", F.explode(kinds).alias("r")) \
             .select(*keys, "r.kind", "r.label", "precision", "recall", "f1", "support", "tp")
    kind, tot = F.col("kind"), F.sum("support")

    def value(c):
        return F.when(F.first(kind) == "weighted avg", F.try_divide(F.sum(F.col(c) * F.col("support")), tot)).otherwise(F.avg(c))

    accuracy = F.first(kind) == "accuracy"
    return rows.groupBy(*keys, "kind", "label").agg(
        F.bround(F.when(~accuracy, value("precision")), R).alias("precision"),
        F.bround(F.when(~accuracy, value("recall")), R).alias("recall"),
        F.bround(F.when(accuracy, F.try_divide(F.sum("tp"), tot)).otherwise(value("f1")), R).alias("f1"),
        tot.cast("bigint").alias("support")).drop("kind")


def confusion_matrix(df: DataFrame, keys=(), labels=dicts.POLARITIES, y_true: str = "y_true",
                     y_pred: str = "y_pred") -> DataFrame:
    """Long confusion matrix (keys, y_true, y_pred, n) with zero cells kept
    for the given labels and any other label that the key holds.  The grid of a key
    is generated from its labels (no join of data against data)."""
    keys = list(keys)
    c = pair_counts(df, keys, y_true, y_pred)
    seen = F.flatten(F.collect_set(F.array("y_true", "y_pred")))
    lab = F.array_union(F.array(*[F.lit(x) for x in labels]), F.array_sort(F.array_compact(F.array_distinct(seen))))
    grid = (c.groupBy(*keys).agg(lab.alias("_labels"))
             .select(*keys, "_labels", F.explode("_labels").alias("y_true"))
             .select(*keys, "y_true", F.explode("_labels").alias("y_pred")))
    return grid.join(c, keys + ["y_true", "y_pred"], "left") \
               .withColumn("n", F.coalesce(F.col("n"), F.lit(0)).cast("bigint"))


def fold_metrics(df: DataFrame, keys=(), fold: str = "fold", y_true: str = "y_true",
                 y_pred: str = "y_pred") -> DataFrame:
    """Per group: mean and population std of the per-fold macro metrics, and
    the metrics pooled over all folds (computed on the concatenated
    predictions, not averaged).  Each count row feeds its fold and the pooled
    pseudo-fold 0, so per-fold and pooled metrics come from one count table
    and one final aggregation."""
    keys = list(keys)
    if not keys:
        df, keys = df.withColumn("__all", F.lit(0)), ["__all"]
        return fold_metrics(df, keys, fold, y_true, y_pred).drop("__all")
    c = pair_counts(df, keys + [fold], y_true, y_pred)
    both = F.explode(F.array(F.col(fold).cast("int"), F.lit(0)))
    c = c.select(*keys, both.alias("__f"), "y_true", "y_pred", "n") \
         .groupBy(*keys, "__f", "y_true", "y_pred").agg(F.sum("n").alias("n"))
    m = macro_from_stats(label_stats(c, keys + ["__f"]), keys + ["__f"])
    is_fold = F.col("__f") != 0

    def per_fold(x):
        return F.when(is_fold, F.col(x))

    def pooled(x):
        return F.max(F.when(~is_fold, F.col(x)))

    return m.groupBy(*keys).agg(
        F.count_if(is_fold).alias("n_folds"),
        F.bround(F.avg(per_fold("f1_macro")), R).alias("f1_fold_mean"),
        F.bround(F.stddev_pop(per_fold("f1_macro")), R).alias("f1_fold_std"),
        F.bround(F.avg(per_fold("precision_macro")), R).alias("precision_fold_mean"),
        F.bround(F.avg(per_fold("recall_macro")), R).alias("recall_fold_mean"),
        pooled("f1_macro").alias("f1_pooled"),
        pooled("precision_macro").alias("precision_pooled"),
        pooled("recall_macro").alias("recall_pooled"),
        pooled("n_samples").alias("n_samples"))


def class_weights(df: DataFrame, label: str = "polarity", keys=()) -> DataFrame:
    """Balanced weights n / (k * n_c) per class (per group of ``keys``)."""
    keys = list(keys)
    c = df.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("n_c"))
    from pyspark.sql import Window
    w = Window.partitionBy(*keys) if keys else Window.partitionBy()
    # the count table has one row per (group, class): small by construction
    c = c.withColumn("__n", F.sum("n_c").over(w)).withColumn("__k", F.count(F.lit(1)).over(w))
    return c.withColumn("weight", F.bround(F.col("__n") / (F.col("__k") * F.col("n_c")), R)) \
            .drop("__n", "__k")


def add_class_weights(df: DataFrame, label: str = "polarity", out: str = "weight") -> DataFrame:
    """Attach the balanced weight to every row (the per-class table is
    broadcast after a size check: no shuffle of rows by a hot class)."""
    from aspectra.session import broadcast_if_small
    w = class_weights(df, label).select(label, F.col("weight").alias(out))
    return df.join(broadcast_if_small(w), label)  # one row per class
