"""Mixing sources to target weights by Poisson replication.

Each document is repeated a Poisson number of times whose mean is its source's
repetition rate.  The number is the inverse of the Poisson distribution at a
hash of seed and document, so it does not depend on partitions or on the other
documents, and a second run gives the same rows.  The copies are then shuffled
globally: dealt out by a hash and sorted by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aspectra.llm.common import broadcast_checked

#: Temperature of the default weights: a source's share of characters to this power.
ALPHA = 0.7


def uniform(*parts) -> Column:
    """A number in (0, 1) from 52 bits of the MD5 of the parts, joined by '|'."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    bits = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")
    return (bits.cast("double") + 0.5) / F.lit(float(1 << 52))


def source_sizes(docs: DataFrame, source_col: str, size: Column) -> DataFrame:
    """(source, size): the total size of each source over all rows."""
    return (docs.select(F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"), size.alias("size"))
            .groupBy("source").agg(F.sum("size").cast("double").alias("size")))


def rates(sizes: DataFrame, weights: dict[str, float] | DataFrame | None = None, epochs: float = 1.0,
          alpha: float = ALPHA) -> DataFrame:
    """(source, rate): mean repetitions that bring each source to its weight when
    the mixture has ``epochs`` times the size of the corpus.  Sources without a
    weight are left out if weights are given; else weights are size ** alpha."""
    if weights is None:
        w = sizes.select("source", "size", F.pow("size", F.lit(alpha)).alias("weight"))
    else:
        if isinstance(weights, dict):
            spark = sizes.sparkSession
            weights = spark.createDataFrame(list(weights.items()), "source string, weight double")
        w = sizes.join(weights.select("source", F.col("weight").cast("double")), "source")
    sums = w.agg(F.sum("size").alias("all_size"), F.sum("weight").alias("all_weight"))
    total = sizes.agg(F.sum("size").alias("corpus"))
    return (w.where("size > 0").join(F.broadcast(sums)).join(F.broadcast(total))       # one row each
            .select("source", (F.lit(float(epochs)) * F.col("corpus") * F.col("weight") / F.col("all_weight") / F.col("size")).alias("rate")))


def _tables(r: DataFrame) -> DataFrame:
    """(source, rate, steps): the Poisson distribution function of each source at
    0, 1, ... up to far beyond the last number that 52 bits can draw.  A document's
    count is the number of steps below its uniform number."""
    top = "cast(ceil(rate + 12 * sqrt(rate) + 40) as int)"
    steps = F.expr(
        f"aggregate(sequence(1, {top}), named_struct('logp', -rate, 'f', exp(-rate), 'all', array(exp(-rate))), "
        "(a, i) -> named_struct('logp', a.logp + ln(rate / i), 'f', a.f + exp(a.logp + ln(rate / i)), "
        "'all', array_append(a.all, a.f + exp(a.logp + ln(rate / i)))), a -> a.all)")
    return r.select("source", "rate", steps.alias("steps"))


def mix(docs: DataFrame, weights: dict[str, float] | DataFrame | None = None, epochs: float = 1.0, seed: int = 17,
        id_col: str = "doc_id", source_col: str = "source", size: Column | None = None, alpha: float = ALPHA,
        copy_col: str = "copy", order_col: str = "shuffle_key") -> DataFrame:
    """The mixture: the rows of ``docs`` repeated, with all their columns, plus
    ``copy`` (1, 2, ...) and ``shuffle_key``, by whose order they are dealt.

    ``size`` measures a document (default: characters of ``text``; null: 0).  A
    null source counts as ''; a null id hashes as ''.  Rows that are equal in id
    and source draw the same number.  Sources of size 0 or (with given weights)
    without weight are left out.  Columns of ``docs`` that bear the names of the
    two added ones are replaced.  An empty table gives an empty result."""
    size = F.coalesce(F.length("text"), F.lit(0)) if size is None else size
    r = _tables(rates(source_sizes(docs, source_col, size), weights, epochs, alpha))
    r = broadcast_checked(r).withColumnRenamed("source", "_source")
    held = docs.select(F.struct("*").alias("_row"), F.col(id_col).cast("string").alias("_id"),
                       F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("_s"))
    u = uniform(F.lit(seed), F.col("_s"), F.col("_id"))
    n = F.size(F.filter("steps", lambda f: f < F.col("_u")))
    rows = (held.join(r, F.col("_s") == F.col("_source")).withColumn("_u", u).withColumn("_n", n).where("_n > 0")
            .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_n")))))
    key = uniform(F.lit(seed), F.lit("order"), F.col("_s"), F.col("_id"), F.col("_copy"))
    rows = rows.withColumn("_key", key).repartition("_key").sortWithinPartitions("_key", "_id", "_copy")
    keep = [c for c in docs.columns if c not in (copy_col, order_col)]
    return rows.select(*[F.col(f"_row.`{c}`").alias(c) for c in keep], F.col("_copy").cast("long").alias(copy_col),
                       F.col("_key").alias(order_col))
