"""Benchmark decontamination by spaced-seed hashing.

Fixed masks pick some of the words of a window and ignore the others, so a
window still hits after a word in an ignored place was replaced.  The masks of a
window's length hit every pattern of substitutions that the comparison accepts.  Hashes of all
windows of the benchmark and of the documents are joined; around each hit the
words of item and document are compared on the hit's diagonal, and an overlap
with few substitutions confirms it.  DataFrame functions only; the documents'
windows meet the benchmark's where they are read and are not shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aspectra.llm.common import broadcast_checked
from aspectra.session import cut_lineage

#: 1: the word counts, 0: any word.  By the words of a window: masks of which one, at
#: some place in the window, meets none of the words that may differ, wherever these are
#: (found by greedy cover, tested on all patterns).
MASKS = {
    5: ("1111", "11101", "11011", "10111"), 6: ("1111", "11011"), 7: ("11011",), 8: ("11011", "1111", "1100011"),
    9: ("11101", "100111"), 10: ("11101", "1111"), 11: ("11101",), 12: ("11101", "10111"), 13: ("111011", "1100001011", "110111"),
}
WINDOW, EQUAL = 13, 0.75     # an overlap has a window of so many words of which this share is equal
MIN_ITEM = 5                 # words of the shortest item that can be told from common phrases
_SEPARATOR = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _words(text: str):
    return F.filter(F.split(F.lower(F.coalesce(F.col(text).cast("string"), F.lit(""))), _SEPARATOR), lambda w: w != "")


def _windows(words: str, masks) -> Column:
    """One hash array per mask: element i is the window that begins at word i.
    ``words`` are the hashes of the words."""
    out = []
    for m in masks:
        at = [i for i, c in enumerate(m) if c == "1"]
        picked = ", ".join("word" if i == 0 else f"get({words}, i + {i})" for i in at)
        out.append(F.expr(f"slice(transform({words}, (word, i) -> xxhash64('{m}', {picked})), 1, greatest(size({words}) - {len(m) - 1}, 0))"))
    return F.flatten(F.array(*[F.transform(a, lambda h, i: F.struct(i.alias("at"), h.alias("h"))) for a in out]))


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               item_col: str = "item_id", item_text: str = "text", masks=MASKS, window: int = WINDOW,
               equal: float = EQUAL) -> DataFrame:
    """(doc_id, item_id, n_equal, n_overlap): confirmed overlaps, the best one of
    each pair.  n_overlap words of the item lie between the first and the last
    word of its passing windows, n_equal of them are equal.

    Words are lower-cased runs of letters, digits and non-ASCII characters.
    Items of fewer words than ``window`` are one window of their length, those of
    fewer than MIN_ITEM words are never looked up.  ``masks`` holds the masks of
    each length; MASKS is whole for the default window and share.  Null or empty texts match nothing; null ids are left
    out; rows that share an id count as one document."""
    items = (benchmark.select(F.col(item_col).alias("item_id"), _words(item_text).alias("iw")).where(f"size(iw) >= {MIN_ITEM}")
             .where("item_id is not null"))
    items = cut_lineage(items)
    hashed = lambda words: F.transform(words, lambda w: F.xxhash64(w))
    length = F.least(F.size("iw"), F.lit(window))
    # at most `window` distinct lengths reach the driver
    lengths = sorted(r[0] for r in items.select(length).distinct().collect())
    used = sorted({m for n in lengths for m in masks[n]})
    own = F.array(*[F.when(length == n, _windows("ih", masks[n])) for n in lengths]) if lengths else F.array(_windows("ih", masks[window]))
    seeds = (items.select("item_id", "iw", hashed("iw").alias("ih"))
             .select("item_id", F.explode(F.flatten(F.filter(own, lambda x: x.isNotNull()))).alias("s"))
             .select("item_id", F.col("s.at").alias("iat"), "s.h").distinct())
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), _words(text_col).alias("w"))
    found = _windows("h", used or masks[window])
    windows = texts.select("doc_id", hashed("w").alias("h")).select("doc_id", F.explode(found).alias("s")).select("doc_id", "s.at", "s.h")
    hits = cut_lineage(windows.join(broadcast_checked(seeds), "h")
                       .select("doc_id", "item_id", (F.col("at") - F.col("iat")).alias("shift")).distinct())
    held = texts.join(broadcast_checked(hits.select("doc_id").distinct()), "doc_id", "left_semi")
    pairs = held.join(broadcast_checked(hits), "doc_id").join(broadcast_checked(items), "item_id")
    same = F.expr("transform(iw, (x, i) -> int(coalesce(i + shift >= 0 and get(w, i + shift) = x, false)))")
    need = F.expr(f"least({window}, size(iw))")
    pairs = pairs.select("doc_id", "item_id", same.alias("e"), need.alias("k"))
    ok = F.expr(f"filter(sequence(0, size(e) - k), i -> aggregate(slice(e, i + 1, k), 0, (a, x) -> a + x) >= {equal} * k)")
    pairs = pairs.withColumn("ok", ok).where("size(ok) > 0")
    span = F.expr("slice(e, array_min(ok) + 1, array_max(ok) + k - array_min(ok))")
    pairs = pairs.select("doc_id", "item_id", F.aggregate(span, F.lit(0), lambda a, x: a + x).alias("n_equal"), F.size(span).alias("n_overlap"))
    return (pairs.groupBy("doc_id", "item_id").agg(F.max(F.struct("n_equal", (-F.col("n_overlap")).alias("less"))).alias("m"))
            .select("doc_id", "item_id", F.col("m.n_equal").cast("long").alias("n_equal"), (-F.col("m.less")).cast("long").alias("n_overlap")))


def leaks_by_document(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, contaminated, n_items, item_ids (sorted,
    comma-joined, '' if none), n_equal (most equal words of one overlap)."""
    id_col = options.get("id_col", "doc_id")
    found = (find_leaks(docs, benchmark, **options).groupBy("doc_id")
             .agg(F.sort_array(F.collect_set("item_id")).alias("ids"), F.max("n_equal").alias("n_equal")))   # at most one entry per item
    found = broadcast_checked(found).withColumnRenamed("doc_id", "_id")
    return (docs.select(F.col(id_col).alias("doc_id")).join(found, F.col("doc_id") == F.col("_id"), "left")
            .select("doc_id", F.col("ids").isNotNull().alias("contaminated"), F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_items"),
                    F.coalesce(F.array_join("ids", ","), F.lit("")).alias("item_ids"), F.coalesce("n_equal", F.lit(0)).cast("long").alias("n_equal")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` without confirmed overlap, with all their columns."""
    id_col = options.get("id_col", "doc_id")
    found = broadcast_checked(find_leaks(docs, benchmark, **options).select(F.col("doc_id").alias("_id")).distinct())
    held = docs.select(F.struct("*").alias("_row"))
    return held.join(found, F.col(f"_row.`{id_col}`") == F.col("_id"), "left_anti").select("_row.*")
