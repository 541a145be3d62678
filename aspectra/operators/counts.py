"""Distribution reports: value counts and cross tabulations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aspectra import dicts


def value_counts(df: DataFrame, cols=("lang", "polarity", "aspect", "emotion")) -> DataFrame:
    """Counts of every value of several columns in one pass: each row emits one
    (dimension, value) pair per column, partial aggregation collapses them
    map-side, and the shuffle carries at most (#values x #partitions) rows."""
    cols = [c for c in cols if c in df.columns]
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("dimension"),
                                         F.col(c).cast("string").alias("value"))
                                for c in cols]))
    return (df.select(pairs.alias("p"))
              .groupBy(F.col("p.dimension").alias("dimension"), F.col("p.value").alias("value"))
              .agg(F.count(F.lit(1)).alias("n")))


def pivot_count(df: DataFrame, keys, col: str, values) -> DataFrame:
    """keys x values counts (0 for missing cells) as ONE partial/final
    aggregation: a conditional count per explicit value, instead of
    ``pivot`` (which plans two aggregations and two shuffles)."""
    return df.groupBy(*keys).agg(*[F.count_if(F.col(col) == F.lit(v)).alias(v) for v in values])


def pivot_max(df: DataFrame, keys, col: str, values, value: str, names=None) -> DataFrame:
    """keys x values max(value) (null for missing cells), one aggregation."""
    names = names or list(values)
    return df.groupBy(*keys).agg(*[F.max(F.when(F.col(col) == F.lit(v), F.col(value))).alias(nm)
                                   for v, nm in zip(values, names)])


def crosstab(df: DataFrame, row: str, col: str, values) -> DataFrame:
    """row x col counts, missing cells 0; pivot values are explicit."""
    return pivot_count(df, [row], col, values)


def crosstab_lang_polarity(df: DataFrame) -> DataFrame:
    return crosstab(df, "lang", "polarity", dicts.POLARITIES)


def crosstab_lang_aspect(df: DataFrame) -> DataFrame:
    return crosstab(df, "lang", "aspect", dicts.ASPECTS)
