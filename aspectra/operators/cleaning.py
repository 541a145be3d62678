"""The corpus chain: gates, aspect mapping, quotas, model text, publication."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aspectra import dicts
from aspectra.functions import text as T
from aspectra.operators.emotions import keyword_emotion
from aspectra.operators.labeling import assert_columns, choose_model_text, encode_emotion, filter_lang_aspect, map_aspects
from aspectra.operators.sampling import balance_corpus
from aspectra.session import cut_lineage
from aspectra.sources.corpus import REQUIRED, scan_corpus, write_corpus

MIN_ROWS = 30                      # rows a language needs for a classifier of its own
MIN_ROWS_BY_LANG = {"ru": 100}     # rows below which a language is only reported on


def language_gates(df: DataFrame, languages=dicts.LANGUAGES, label: str = "polarity", min_rows: int = MIN_ROWS,
                   min_by_lang=MIN_ROWS_BY_LANG, min_classes: int = 2) -> DataFrame:
    """(lang, n_rows, n_classes, need, status): one row per expected language and
    per other language that occurs (null included).  Status ``empty``: no row,
    ``scarce``: fewer rows than needed, ``single_class``, else ``ok``."""
    seen = df.groupBy("lang").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(label).alias("n_classes"))
    zero = F.lit(0).cast("bigint")
    expected = df.sparkSession.createDataFrame([(x,) for x in languages], "lang string").select("lang", zero.alias("n_rows"), zero.alias("n_classes"))
    both = seen.unionByName(expected).groupBy("lang").agg(F.max("n_rows").alias("n_rows"), F.max("n_classes").alias("n_classes"))
    need = F.lit(min_rows)
    for lang, n in min_by_lang.items():
        need = F.when(F.col("lang") == lang, F.lit(n)).otherwise(need)
    status = (F.when(F.col("n_rows") == 0, "empty").when(F.col("n_rows") < F.col("need"), "scarce")
               .when(F.col("n_classes") < min_classes, "single_class").otherwise("ok"))
    return both.withColumn("need", need.cast("bigint")).withColumn("status", status)


def build_clean_corpus(df: DataFrame, path: str, target_per_lang: int = dicts.TARGET_PER_LANG, terms=dicts.ASPECT_TERMS,
                       id_col: str = "review_id", fmt: str = "parquet") -> DataFrame:
    """Maps aspects, draws the polarity quotas per language, adds ``absa_input``,
    publishes the table at ``path`` and returns it read back.

    ``text``, ``polarity`` and ``lang`` are required (ValueError); without an
    ``aspect`` column nothing is mapped and ``absa_input`` is the text.  An empty
    result is a RuntimeError, raised before ``path`` is touched.  The drawn
    corpus is bounded by ``target_per_lang`` times the number of languages; it is
    checkpointed, so the draw runs once."""
    mapped = assert_columns(df, REQUIRED).transform(map_aspects, terms=terms)
    drawn = balance_corpus(mapped, target_per_lang, id_col)
    text = T.absa_input("aspect", "text") if "aspect" in df.columns else F.coalesce(F.col("text"), F.lit(""))
    drawn = cut_lineage(drawn.withColumn("absa_input", text))
    if drawn.isEmpty():
        raise RuntimeError("empty corpus after aspect mapping and quotas: check aspects, polarities and languages of the input")
    return scan_corpus(df.sparkSession, write_corpus(drawn, path, fmt), fmt)


def emotion_input(df: DataFrame, lang: str = "all", min_rows: int = MIN_ROWS) -> DataFrame:
    """Rows an emotion classifier trains on: emotion, label 0..4 and model_input.

    An ``emotion`` column that holds any value is used as it is (rows with an
    unknown or null emotion are dropped); a missing or all-null one is filled by
    the keyword rule.  Fewer than ``min_rows`` rows of the language are a
    ValueError; the count stops there."""
    rows = filter_lang_aspect(df, lang)
    n = rows.limit(min_rows).count()
    if n < min_rows:
        raise ValueError(f"only {n} rows for language {lang!r}, {min_rows} needed")
    if "emotion" not in df.columns or rows.where(F.col("emotion").isNotNull()).isEmpty():
        rows = keyword_emotion(rows)
    return rows.transform(encode_emotion).transform(choose_model_text)
