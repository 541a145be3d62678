"""The METRIC table and the comparison matrices derived from it.

The long form (row key, column key, value) is the primary output; wide
matrices pivot it over an explicit, ordered column list so their schema is
stable and no extra job discovers pivot values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aspectra import dicts
from aspectra.operators.metrics import label_stats, pair_counts
from aspectra.session import cut_lineage

FAMILIES = ["svm", "transformer"]


def model_short(model: Column) -> Column:
    """Display name: dictionary, else the first 8 characters."""
    return F.coalesce(dicts.lookup(dicts.MODEL_SHORT, model), F.substring(model, 1, 8))


def family_of(short: Column) -> Column:
    return F.when(short == dicts.BASELINE_MODEL, F.lit("svm")).otherwise(F.lit("transformer"))


def metric_table(preds: DataFrame, lang_expr: Column | None = None) -> DataFrame:
    """METRIC rows (model, model_short, family, lang, aspect, f1_macro,
    precision_macro, recall_macro, n_samples) from a prediction table: one
    row per (model, lang, aspect) and one overall row (aspect null) per
    (model, lang).  Counts are additive, so the overall rows come from the
    small per-aspect count table, not from a second pass over predictions."""
    p = preds if lang_expr is None else preds.withColumn("lang", lang_expr)
    c = pair_counts(p, ["model", "lang", "aspect"])
    # every count row also feeds the overall row (aspect null) of its group
    both = F.explode(F.array(F.col("aspect"), F.lit(None).cast("string")))
    counts = c.select("model", "lang", both.alias("aspect"), "y_true", "y_pred", "n") \
              .groupBy("model", "lang", "aspect", "y_true", "y_pred").agg(F.sum("n").alias("n"))
    keys = ["model", "lang", "aspect"]
    st = label_stats(counts, keys)
    m = st.groupBy(*keys).agg(
        F.bround(F.avg("f1"), 4).alias("f1_macro"),
        F.bround(F.avg("precision"), 4).alias("precision_macro"),
        F.bround(F.avg("recall"), 4).alias("recall_macro"),
        F.sum("support").cast("bigint").alias("n_samples"))
    short = model_short(F.col("model"))
    return m.withColumn("model_short", short).withColumn("family", family_of(short))


def consolidate_metrics(svm: DataFrame, models: DataFrame) -> DataFrame:
    """Union of the baseline family and the model families (missing columns
    become null) with display names filled from the dictionary."""
    u = svm.unionByName(models, allowMissingColumns=True)
    short = F.coalesce(F.col("model_short"), model_short(F.col("model"))) \
        if "model_short" in u.columns else model_short(F.col("model"))
    u = u.withColumn("model_short", short)
    return u.withColumn("family", F.coalesce(F.col("family"), family_of(F.col("model_short")))
                        if "family" in u.columns else family_of(F.col("model_short")))


def lang_label(lang: Column) -> Column:
    return F.coalesce(dicts.lookup(dicts.LANG_LABEL, lang), F.upper(lang))


MAX_COLUMNS = 1_000          # columns that a matrix may get


def _columns(rows: DataFrame, col: str, listed: list[str]) -> list[str]:
    """The listed values of ``col``, then the others that occur, in order.  Only distinct
    values reach the driver, and no more than MAX_COLUMNS of them."""
    more = rows.where(F.col(col).isNotNull() & ~F.col(col).isin(listed)).select(col).distinct()
    found = sorted(r[0] for r in more.limit(MAX_COLUMNS + 1).collect())
    if len(found) > MAX_COLUMNS:
        raise ValueError(f"more than {MAX_COLUMNS} values of {col}")
    return [*listed, *found]


def global_matrix(metric: DataFrame) -> DataFrame:
    """model_short x language, max overall F1: the listed languages, then any other
    language that occurs, by its upper-cased code."""
    from aspectra.operators.counts import pivot_max
    rows = cut_lineage(metric.filter(F.col("aspect").isNull()).select("model_short", "lang", "f1_macro"))
    langs = _columns(rows, "lang", [lg for lg, _ in dicts.LANG_LABEL])
    names = [lab for _, lab in dicts.LANG_LABEL]
    names += [lg.upper() for lg in langs[len(names):]]
    return pivot_max(rows, ["model_short"], "lang", langs, "f1_macro", names)


def expand_all_lang(metric: DataFrame) -> DataFrame:
    """Rows of the pooled language 'all' replicated to fr, en and ru."""
    langs = F.when(F.col("lang") == "all", dicts.array_literal(dicts.LANGUAGES)) \
             .otherwise(F.array(F.col("lang")))
    return metric.withColumn("lang", F.explode(langs))


def matrix_columns() -> list[str]:
    return [f"{m}({lab})" for l, lab in dicts.LANG_LABEL if l in dicts.LANGUAGES
            for m in dicts.MATRIX_MODEL_ORDER]


def absa_long(metric: DataFrame) -> DataFrame:
    """(aspect, lang, model_short, col_label, f1) for the five categories,
    after expanding 'all'; repeated runs collapse by max."""
    m = expand_all_lang(metric.filter(F.col("aspect").isin(dicts.ASPECTS)))
    m = m.withColumn("col_label", F.concat(F.col("model_short"), F.lit("("), F.upper(F.col("lang")), F.lit(")")))
    return m.groupBy("aspect", "lang", "model_short", "col_label").agg(F.max("f1_macro").alias("f1_macro"))


def absa_matrix(metric: DataFrame) -> DataFrame:
    """aspect x MODEL(LANG) matrix of max F1, rows in category order.  Columns: per
    language SVM, XLM-R, CamemBERT, RuBERT, then any other MODEL(LANG) that occurs."""
    from aspectra.operators.counts import pivot_max
    rows = cut_lineage(absa_long(metric))
    wide = pivot_max(rows, ["aspect"], "col_label", _columns(rows, "col_label", matrix_columns()), "f1_macro")
    return wide.orderBy(F.array_position(dicts.array_literal(dicts.ASPECTS), F.col("aspect")))


def gain_vs_baseline(metric: DataFrame, baseline: str = dicts.BASELINE_MODEL) -> DataFrame:
    """F1(model) - F1(baseline) at equal (aspect, lang), long form; cells
    without a baseline give no row (the wide form would show null)."""
    a = absa_long(metric)
    base = a.filter(F.col("model_short") == baseline) \
            .select("aspect", "lang", F.col("f1_macro").alias("base_f1"))
    g = a.filter(F.col("model_short") != baseline).join(base, ["aspect", "lang"])
    return g.select("aspect", "lang", "model_short", "col_label",
                    F.bround(F.col("f1_macro") - F.col("base_f1"), 4).alias("gain"))


def comparison_table(metric: DataFrame) -> DataFrame:
    """One row per result (overall rows): name, lang ('N/A' if missing),
    macro F1 / precision / recall (0 if missing), n, model name; best first."""
    o = metric.filter(F.col("aspect").isNull())
    name = F.concat_ws("_", F.col("family"), F.regexp_replace(F.col("model"), "/", "_"),
                       F.coalesce(F.col("lang"), F.lit("N/A")))
    return o.select(name.alias("name"), F.coalesce(F.col("lang"), F.lit("N/A")).alias("lang"),
                    F.coalesce(F.col("f1_macro"), F.lit(0.0)).alias("macro_f1"),
                    F.coalesce(F.col("precision_macro"), F.lit(0.0)).alias("precision"),
                    F.coalesce(F.col("recall_macro"), F.lit(0.0)).alias("recall"),
                    F.coalesce(F.col("n_samples"), F.lit(0)).cast("bigint").alias("n_samples"),
                    F.col("model").alias("model_name"), "family").orderBy(F.desc("macro_f1"), "name")


def best_model(comparison: DataFrame) -> DataFrame:
    """Top row by macro F1 (ties by name): TakeOrderedAndProject."""
    return comparison.orderBy(F.desc("macro_f1"), F.asc("name")).limit(1)


def family_summary(comparison: DataFrame) -> DataFrame:
    """Mean and best F1 per family."""
    best = F.min_by(F.struct(F.col("name"), F.col("macro_f1")),
                    F.struct(-F.col("macro_f1"), F.col("name")))
    return comparison.groupBy("family").agg(
        F.bround(F.avg("macro_f1"), 4).alias("mean_f1"),
        best.getField("name").alias("best_name"),
        F.max("macro_f1").alias("best_f1"),
        F.count(F.lit(1)).alias("n_results"))


def best_per_lang(comparison: DataFrame, families=FAMILIES) -> DataFrame:
    """Best F1 per (language, family), 0 when the family has no result;
    rows without language are excluded."""
    c = comparison.filter(F.col("lang") != "N/A")
    grid = c.select("lang").distinct().select("lang", F.explode(dicts.array_literal(families)).alias("family"))
    best = c.groupBy("lang", "family").agg(F.max("macro_f1").alias("best_f1"))
    return grid.join(best, ["lang", "family"], "left") \
               .withColumn("best_f1", F.coalesce(F.col("best_f1"), F.lit(0.0)))


def evaluation_report(comparison: DataFrame) -> DataFrame:
    """Report rows: the best result, then mean and best per family."""
    b = best_model(comparison).select(F.lit("best_model").alias("section"),
                                      F.lit(None).cast("string").alias("family"),
                                      "name", F.col("macro_f1").alias("value"))
    fs = family_summary(comparison)
    mean = fs.select(F.lit("family_mean").alias("section"), "family",
                     F.lit(None).cast("string").alias("name"), F.col("mean_f1").alias("value"))
    top = fs.select(F.lit("family_best").alias("section"), "family",
                    F.col("best_name").alias("name"), F.col("best_f1").alias("value"))
    return b.unionByName(mean).unionByName(top)


def full_report(comparison: DataFrame) -> DataFrame:
    """Every figure of the report: the best result, the whole comparison table and,
    per family, its mean and its best result; in the order of the report."""
    cols = ["family", "name", "lang", "macro_f1", "precision", "recall", "n_samples", "model_name"]
    rows = comparison.select(*cols)
    by_family = rows.groupBy("family").agg(
        F.bround(F.avg("macro_f1"), 4).alias("mean"), F.count(F.lit(1)).alias("n"),
        F.min_by(F.struct(*cols[1:]), F.struct(-F.col("macro_f1"), F.col("name"))).alias("best"))
    none = lambda c, t: F.lit(None).cast(t).alias(c)
    mean = by_family.select(F.lit("family_mean").alias("section"), "family", none("name", "string"), none("lang", "string"),
                            F.col("mean").alias("macro_f1"), none("precision", "double"), none("recall", "double"),
                            F.col("n").alias("n_samples"), none("model_name", "string"))
    parts = [best_model(rows).select(F.lit("best_model").alias("section"), *cols), rows.select(F.lit("table").alias("section"), *cols), mean,
             by_family.select(F.lit("family_best").alias("section"), "family", *[F.col(f"best.{c}").alias(c) for c in cols[1:]])]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    place = F.array_position(dicts.array_literal(["best_model", "table", "family_mean", "family_best"]), F.col("section"))
    return out.orderBy(place, F.desc("macro_f1"), "name", "family")


def full_report_lines(report: DataFrame) -> DataFrame:
    """``full_report`` as text lines, figures to 4 places, '-' for none."""
    text = [F.coalesce(F.col(c), F.lit("-")) for c in ("section", "family", "name", "lang")]
    figures = [F.when(F.col(c).isNull(), F.lit("-")).otherwise(F.format_string("%.4f", F.col(c))) for c in ("macro_f1", "precision", "recall")]
    return report.select(F.concat_ws(" | ", *text, *figures, F.col("n_samples").cast("string")).alias("value"))


def report_lines(report: DataFrame) -> DataFrame:
    """Text lines of the report (for ``write.text``)."""
    line = F.concat_ws(" | ", F.col("section"), F.coalesce(F.col("family"), F.lit("-")),
                       F.coalesce(F.col("name"), F.lit("-")), F.format_number(F.col("value"), 4))
    return report.select(line.alias("value"))
