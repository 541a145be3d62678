"""Reproducible sampling, stratified quotas, splits and folds.

Two scalable building blocks replace per-group pandas draws:

* ``top_k_per_group`` — the k rows with the smallest md5 key per group,
  computed without ranking whole groups: a uniform drawn from the same key
  pre-filters each group to a little more than k candidates (a prefix of the
  key order, so exact), groups that fall short are re-ranked in full, and only
  the candidates are ranked (``row_number() <= k`` gets WindowGroupLimit).
  A group holding a third of all rows therefore never lands in one task.

* ``rank_in_strata`` — the exact 1-based rank of every row inside its stratum
  by md5 key, without a window over a whole stratum: rows are numbered inside
  (stratum, key-prefix bucket) and shifted by the count of earlier buckets,
  taken from a small (stratum, bucket) count table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aspectra import dicts
from aspectra.functions.hashing import bucket_of, hex_prefix_int, order_key


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


MAX_BROADCAST_GROUPS = 100_000


def _join_null_safe(df: DataFrame, other: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` where a null key is a group of its own."""
    other = other.withColumnsRenamed({c: f"__o_{c}" for c in keys})
    cond = F.lit(True)
    for c in keys:
        cond &= F.col(c).eqNullSafe(F.col(f"__o_{c}"))
    return df.join(other, cond, how).drop(*[f"__o_{c}" for c in keys])


def top_k_per_group(df: DataFrame, groups: list[str], k, key: Column,
                    tiebreak: list[str], margin: float = 1.25, slack: int = 64) -> DataFrame:
    """Rows whose rank by ``key`` within ``groups`` is <= k (k: int or column
    name holding a per-row quota).  Adds ``__rank``.

    The per-group tables (counts, short groups) have one row per group.  Their
    size is checked first; up to MAX_BROADCAST_GROUPS rows they are broadcast,
    so the rows (text included) are never shuffled by a group key that may
    hold a third of the data.  Beyond the bound a regular join is used."""
    kcol = F.lit(k) if isinstance(k, int) else F.col(k)
    d = df.withColumn("__key", key).withColumn("__k", kcol)
    d = d.withColumn("__u", hex_prefix_int(F.col("__key")) / F.lit(float(1 << 60)))
    n = d.groupBy(*groups).agg(F.count(F.lit(1)).alias("__n")).persist()
    small = n.limit(MAX_BROADCAST_GROUPS + 1).count() <= MAX_BROADCAST_GROUPS

    def per_group(t: DataFrame) -> DataFrame:
        return F.broadcast(t) if small else t

    d = _join_null_safe(d, per_group(n), groups)
    thr = F.least(F.lit(1.0), (F.col("__k") * F.lit(margin) + F.lit(slack)) / F.col("__n"))
    d = d.withColumn("__thr", thr)
    # groups whose pre-filter kept fewer than min(k, n) rows are ranked in full
    kept = (d.filter(F.col("__u") < F.col("__thr"))
             .groupBy(*groups).agg(F.count(F.lit(1)).alias("__kept"),
                                   F.first("__k").alias("__kk"), F.first("__n").alias("__nn")))
    short = kept.filter(F.col("__kept") < F.least(F.col("__kk"), F.col("__nn"))) \
                .select(*groups, F.lit(True).alias("__short"))
    d = _join_null_safe(d, per_group(short), groups, "left")  # short groups are a subset of n
    cand = d.filter((F.col("__u") < F.col("__thr")) | F.col("__short").isNotNull())
    w = Window.partitionBy(*groups).orderBy(F.col("__key"), *[F.col(c) for c in tiebreak])
    ranked = cand.withColumn("__rank", F.row_number().over(w)).filter(F.col("__rank") <= F.col("__k"))
    return ranked.drop("__key", "__k", "__u", "__n", "__thr", "__short")


BYTES_PER_BUCKET = 64 << 20


def bucket_digits(df: DataFrame, bytes_per_bucket: int = BYTES_PER_BUCKET) -> int:
    """Hex digits of the md5 prefix used as bucket, from Catalyst's size
    estimate of ``df`` (no job runs): enough buckets that each holds about
    ``bytes_per_bucket`` even if one stratum had every row.  1 digit = 16
    buckets per stratum ... 5 digits = 1M buckets (about 64 TB per stratum)."""
    import math
    try:
        size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except Exception:  # noqa: BLE001 - unknown size: assume large
        return 4
    if size <= bytes_per_bucket * 16:
        return 1
    return max(1, min(5, math.ceil(math.log(size / bytes_per_bucket, 16))))


def rank_in_strata(df: DataFrame, strata: list[str], key: Column, tiebreak: list[str],
                   digits: int | None = None, out: str = "__rank") -> DataFrame:
    """Exact 1-based rank by ``key`` (hex md5) inside each stratum."""
    if digits is None:
        digits = bucket_digits(df)
    d = df.withColumn("__key", key).withColumn("__b", bucket_of(F.col("__key"), digits))
    counts = d.groupBy(*strata, "__b").agg(F.count(F.lit(1)).alias("__bn"))
    wo = Window.partitionBy(*strata).orderBy("__b") if strata else Window.orderBy("__b")
    # the count table has at most 16**digits rows per stratum
    offsets = counts.withColumn(
        "__off", F.coalesce(F.sum("__bn").over(wo.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    if strata:
        offsets = offsets.withColumn("__n_stratum", F.sum("__bn").over(Window.partitionBy(*strata)))
    else:
        offsets = offsets.withColumn("__n_stratum", F.sum("__bn").over(Window.partitionBy()))
    d = _join_null_safe(d, offsets.drop("__bn"), [*strata, "__b"])
    wi = Window.partitionBy(*strata, "__b").orderBy(F.col("__key"), *[F.col(c) for c in tiebreak])
    d = d.withColumn(out, F.col("__off") + F.row_number().over(wi))
    return d.drop("__key", "__b", "__off")


def sample_per_lang(df: DataFrame, n: int = dicts.SAMPLE_PER_LANG, id_col: str = "review_id",
                    lang: str = "lang", seed: int = dicts.SEED) -> DataFrame:
    """At most n rows per language, without replacement, seeded."""
    key = order_key("sample_per_lang", id_col, seed=seed)
    return top_k_per_group(df, [lang], n, key, [id_col]).drop("__rank")


def balance_corpus(df: DataFrame, target_per_lang: int = dicts.TARGET_PER_LANG,
                   id_col: str = "review_id", seed: int = dicts.SEED) -> DataFrame:
    """Per language at most ``target_per_lang`` rows with the polarity quota
    (int(N * ratio) per polarity); strata below quota keep all their rows;
    other polarities are not drawn."""
    spark = df.sparkSession
    quota = dicts.quota_frame(spark, target_per_lang).select("polarity", "quota")
    d = df.join(F.broadcast(quota), "polarity")  # fixed 3-row table
    key = order_key("balance_corpus", id_col, seed=seed)
    return top_k_per_group(d, ["lang", "polarity"], "quota", key, [id_col]).drop("__rank", "quota")


def balance_shortfall(df: DataFrame, target_per_lang: int = dicts.TARGET_PER_LANG) -> DataFrame:
    """(lang, polarity, target, actual) for strata below their quota."""
    langs = df.select("lang").distinct()
    q = F.array(*[F.struct(F.lit(p).alias("polarity"), F.lit(int(target_per_lang * r)).alias("target"))
                  for p, r in dicts.POLARITY_QUOTA])
    grid = langs.select("lang", F.explode(q).alias("s")).select("lang", "s.polarity", "s.target")
    actual = df.groupBy("lang", "polarity").agg(F.count(F.lit(1)).alias("actual"))
    res = grid.join(actual, ["lang", "polarity"], "left") \
              .withColumn("actual", F.coalesce(F.col("actual"), F.lit(0)).cast("bigint"))
    return res.filter(F.col("actual") < F.col("target"))


def split_train_val_test(df: DataFrame, label: str = "polarity", id_col: str = "review_id",
                         test: float = dicts.TEST_SPLIT, val: float = dicts.VAL_SPLIT,
                         seed: int = dicts.SEED, strata_extra: list[str] | None = None,
                         out: str = "split") -> DataFrame:
    """Stratified split: in each stratum the first round(test*n) rows by key
    are test, the next round(val*n) validation, the rest train."""
    strata = (strata_extra or []) + [label]
    key = order_key("split", id_col, seed=seed)
    r = rank_in_strata(df, strata, key, [id_col])
    n_test = F.round(F.col("__n_stratum") * F.lit(test))
    n_val = F.round(F.col("__n_stratum") * F.lit(val))
    s = (F.when(F.col("__rank") <= n_test, "test")
          .when(F.col("__rank") <= n_test + n_val, "val").otherwise("train"))
    return r.withColumn(out, s).drop("__rank", "__n_stratum")


def stratified_kfold(df: DataFrame, label: str = "polarity", id_col: str = "review_id",
                     k: int = dicts.CV_FOLDS, seed: int = dicts.SEED,
                     strata_extra: list[str] | None = None, out: str = "fold") -> DataFrame:
    """Fold 1..k; inside each stratum class sizes differ by at most one per fold."""
    strata = (strata_extra or []) + [label]
    key = order_key("kfold", id_col, seed=seed)
    r = rank_in_strata(df, strata, key, [id_col])
    return r.withColumn(out, ((F.col("__rank") - 1) % k + 1).cast("int")).drop("__rank", "__n_stratum")
