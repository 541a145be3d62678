"""Quality rules whose thresholds follow the data.

Metrics of each text are integers (per mille, or hundredths).  Their
distributions per language and source are kept as mergeable quantile sketches:
counts over exponential buckets of 32 steps per power of two, so a quantile is
off by at most 1/32 and merging is adding counts.  A text is rejected if a
metric lies far outside the quartiles of its own language and source; groups of
few documents use their language, then everything.  All of it is DataFrame
functions; the only shuffle is of bucket counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aspectra.llm.common import broadcast_checked
from aspectra.session import cut_lineage

_SPACE = r"[\x20\x09-\x0D]+"
_WORD = r"[^\x20\x09-\x0D]"

#: metric: (SQL over the text statistics, slack added to the fence, both sides?)
METRICS = {
    "symbols": ("div(1000 * n_symbols, greatest(word_chars, 1))", 40, False),
    "dup_lines": ("div(1000 * n_dup_lines, greatest(n_lines, 1))", 450, False),
    "repeats": ("div(1000 * n_repeat_words, greatest(n_words, 1))", 300, False),
    "word_length": ("div(100 * word_chars, greatest(n_words, 1))", 150, True),
}
FENCE = 6                    # quartile distances beyond a quartile
MIN_GROUP = 100              # documents from which a group has thresholds of its own


def _div(sql: str) -> str:
    """div(a, b) as integer division."""
    a, _, b = sql.removeprefix("div(").removesuffix(")").partition(", ")
    return f"(({a}) div ({b}))"


def text_stats(df: DataFrame, text: str) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words of
    the column ``text`` (null counts as empty)."""
    t = F.coalesce(F.col(text), F.lit(""))
    df = (df.withColumn("_t", t)
          .withColumn("_w", F.filter(F.split("_t", _SPACE), lambda w: w != ""))
          .withColumn("_l", F.filter(F.split("_t", "\n"), lambda x: x.rlike(_WORD)))
          .withColumn("n_words", F.size("_w").cast("long"))
          # hashes of the 3-word windows; shorter texts have none
          .withColumn("_h", F.expr("slice(transform(_w, (w, i) -> xxhash64(w, get(_w, i + 1), get(_w, i + 2))), "
                                   "1, cast(greatest(n_words - 2, 0) as int))"))
          .withColumn("_d", F.size(F.array_distinct("_h"))))
    # 34 bits of hash and 30 of place in one long sort fast; if two different
    # windows share the 34 bits by chance, whole hashes are sorted instead.
    df = df.withColumn("_clash", F.expr("_d < size(_h) and size(array_distinct(transform(_h, h -> h >> 30))) <> _d"))
    df = df.withColumn("_s", F.expr("case when _d < size(_h) and not _clash "
                                    "then sort_array(transform(_h, (h, i) -> (h & -1073741824L) | i)) end"))
    twice = "coalesce(get(_s, k - 1) {0} = x {0}, false) or coalesce(get(_s, k + 1) {0} = x {0}, false)"
    df = df.withColumn("_p", F.expr(
        f"case when not _clash then sort_array(transform(filter(_s, (x, k) -> {twice.format('>> 30')}), x -> x & 1073741823L)) end"))
    df = df.withColumn("_s", F.expr("case when _clash then sort_array(transform(_h, (h, i) -> named_struct('h', h, 'i', i))) end"))
    df = df.withColumn("_p", F.expr(
        f"case when _clash then sort_array(transform(filter(_s, (x, k) -> {twice.format('.h')}), x -> cast(x.i as long))) else _p end"))
    covered = F.expr("aggregate(_p, named_struct('to', -3L, 'n', 0L), "
                     "(a, i) -> named_struct('to', i, 'n', a.n + least(3L, i - a.to)), a -> a.n)")
    return (df.withColumn("word_chars", F.length(F.array_join("_w", "")).cast("long"))
            .withColumn("n_symbols", (F.length("_t") - F.length(F.regexp_replace("_t", r"[#*$%&|<>]+", ""))).cast("long"))
            .withColumn("n_lines", F.size("_l").cast("long"))
            .withColumn("n_dup_lines", (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"))
            .withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
            .drop("_t", "_w", "_l", "_h", "_d", "_clash", "_s", "_p"))


def bucket(v: str) -> str:
    """SQL of the sketch's bucket of a value of 0 or more."""
    e = f"(length(bin({v})) - 1)"
    return f"case when {v} < 32 then {v} else 32 * ({e} - 4) + shiftright({v}, cast({e} - 5 as int)) % 32 end"


def edge(b: str) -> str:
    """SQL of the smallest value of a bucket."""
    return f"case when {b} < 32 then {b} else shiftleft(32 + {b} % 32, cast({b} div 32 - 1 as int)) end"


def sketches(stats: DataFrame) -> DataFrame:
    """(lang, source, metric, bucket, n): the quantile sketches of all groups."""
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.expr(_div(sql)).cast("long").alias("v"))
                               for m, (sql, _, _) in METRICS.items()]))
    return cut_lineage(stats.where("n_words > 0").select("lang", "source", each.alias("m"))
                       .select("lang", "source", "m.metric", F.expr(bucket("m.v")).cast("long").alias("bucket"))
                       .groupBy("lang", "source", "metric", "bucket").agg(F.count(F.lit(1)).alias("n")))


def _quartiles(sketch: DataFrame, by: list[str]) -> DataFrame:
    merged = sketch.groupBy(*by, "metric", "bucket").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*by, "metric")
    at = merged.select("*", F.sum("n").over(w).alias("all"), F.sum("n").over(w.orderBy("bucket")).alias("upto"))
    q = [F.min(F.when(F.col("upto") * 4 >= F.col("all") * k, F.col("bucket"))).alias(f"b{k}") for k in (1, 3)]
    return (at.groupBy(*by, "metric").agg(F.max("all").alias("n"), *q)
            .select(*by, "metric", "n", F.expr(edge("b1")).alias("q1"), F.expr(edge("b3")).alias("q3")))


def thresholds(sketch: DataFrame, min_group: int = MIN_GROUP, fence: int = FENCE) -> DataFrame:
    """One row per language and source: fences (a map from metric to low, high)."""
    groups = sketch.select("lang", "source").distinct()
    own = _quartiles(sketch, ["lang", "source"])
    lang = _quartiles(sketch, ["lang"])
    all_ = _quartiles(sketch.withColumn("every", F.lit(1)), ["every"])
    names = F.explode(F.array(*[F.lit(m) for m in METRICS])).alias("metric")
    grid = groups.select("lang", "source", F.lit(1).alias("every"), names)
    for df, by, p in ((own, ["lang", "source"], "a"), (lang, ["lang"], "b"), (all_, ["every"], "c")):
        df = df.withColumns({f"{p}_{c}": F.col(c) for c in ("n", "q1", "q3")}).drop("n", "q1", "q3")
        grid = grid.join(df, [*by, "metric"], "left")
    pick = lambda c: F.when(F.col("a_n") >= min_group, F.col(f"a_{c}")).when(F.col("b_n") >= min_group, F.col(f"b_{c}")).otherwise(F.col(f"c_{c}"))
    grid = grid.select("lang", "source", "metric", pick("q1").alias("q1"), pick("q3").alias("q3"))
    spread = (F.col("q3") - F.col("q1")) * fence
    ends = []
    for m, (_, slack, both) in METRICS.items():
        mine = F.col("metric") == m
        low = F.max(F.when(mine, F.col("q1") - spread - slack)) if both else F.lit(-1)
        ends += [low.cast("long").alias(f"{m}_low"), F.max(F.when(mine, F.col("q3") + spread + slack)).cast("long").alias(f"{m}_high")]
    return grid.groupBy("lang", "source").agg(*ends)


def _judge(stats: DataFrame, limits: DataFrame) -> DataFrame:
    ok = F.lit(True)
    for m, (sql, _, _) in METRICS.items():
        ok &= F.expr(_div(sql)).between(F.col(f"{m}_low"), F.col(f"{m}_high"))
    failed = F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")
    limits = limits.withColumnsRenamed({"lang": "_lang", "source": "_source"})
    return (stats.join(broadcast_checked(limits), (F.col("lang") == F.col("_lang")) & (F.col("source") == F.col("_source")), "left")
            .withColumn("base_failed", failed)
            .withColumn("kept", ~F.col("base_failed") & F.coalesce(ok, F.lit(False))))


def _input(docs: DataFrame, id_col, text_col, lang_col, source_col, *more) -> DataFrame:
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                       name(lang_col).alias("lang"), name(source_col).alias("source"), *more)


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
            source_col: str = "source", min_group: int = MIN_GROUP) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, base_failed, kept.

    A null text counts as empty and fails (n_words < 50); a null language or
    source counts as ''.  Repeated rows are judged alike; a metric on a fence is
    kept.  Other columns are ignored; an empty table gives an empty result."""
    stats = cut_lineage(text_stats(_input(docs, id_col, text_col, lang_col, source_col), "text").drop("text"))
    return _judge(stats, thresholds(sketches(stats), min_group)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def keep_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                 source_col: str = "source", min_group: int = MIN_GROUP) -> DataFrame:
    """The rows of ``docs`` that ``quality`` keeps, with all their columns.  The
    texts are read twice (for the sketches, for the verdicts) and not shuffled."""
    first = text_stats(_input(docs, id_col, text_col, lang_col, source_col), "text").drop("text")
    limits = cut_lineage(thresholds(sketches(first), min_group))
    stats = text_stats(_input(docs, id_col, text_col, lang_col, source_col, F.struct("*").alias("_row")), "text")
    # a generator instead of a filter, which would be pushed down with the whole statistics inlined in it
    kept = F.explode(F.when(F.col("kept"), F.array("_row")))
    return _judge(stats, limits).select(kept.alias("_row")).select("_row.*")
