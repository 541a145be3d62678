"""Repeated passages at paragraph level: MinHash banding of paragraphs.

Paragraphs (lines with enough words) that are equal word for word are one item.
Items that collide in a band are candidates, links are confirmed by the exact
Jaccard similarity of their shingle sets, and of each component of linked
paragraphs the first occurrence stays.  Bands are tuned for recall: the fewest
bands that miss a pair at the threshold with a probability of at most ``miss``.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aspectra.llm.blocks import confirmed_links, neighbours
from aspectra.llm.common import components, minhash, mix64, sequence_hashes, shingle_sets, text_slices, tidy
from aspectra.session import cut_lineage

ROWS, MISS = 4, 1e-3
MIN_WORDS = 25               # shorter lines are boilerplate or headings, not passages
_SLACK = 5.0


def bands_for(similarity: float, rows: int = ROWS, miss: float = MISS) -> int:
    """The fewest bands of ``rows`` values that miss a pair of this similarity with
    a probability of at most ``miss``."""
    return math.ceil(math.log(miss) / math.log(1 - similarity ** rows))


def _lines(text: bytes):
    """(place, line) of the lines of a text that can be paragraphs."""
    return list(enumerate(text.split(b"\n")))


def _paragraphs(docs: DataFrame, id_col: str, text_col: str, k: int, min_words: int, bands: int, rows: int) -> DataFrame:
    """One row per paragraph: id, place, words, 128-bit print of the words and, for
    each band, 8 bytes."""
    def run(batches):
        import pyarrow as pa
        schema = pa.schema([("id", pa.int64()), ("place", pa.int32()), ("n_words", pa.int32()), ("f1", pa.int64()), ("f2", pa.int64()), ("bands", pa.binary())])
        salt = np.uint64(0xD6E8FEB86659FD93)
        for b in batches:
            ids = b.column("id").to_pylist()
            for first, texts in text_slices(b, "text"):
                where, lines = [], []
                for i, t in enumerate(texts, first):
                    for place, line in _lines(t):
                        if len(line) >= 2 * min_words - 1 and (n := len(line.split())) >= min_words:
                            where.append((ids[i], place, n))
                            lines.append(line)
                out = []
                for w, s, h in zip(where, shingle_sets(lines, k), sequence_hashes(lines), strict=True):
                    sig = minhash(s, bands * rows).astype(np.uint64).reshape(bands, rows)
                    key = sum(sig[:, j] << np.uint64(16 * j) for j in range(1, rows)) + sig[:, 0] if rows <= 4 else mix64(sig).sum(axis=1)
                    out.append((*w, int(h.view(np.int64)), int(mix64(s ^ salt).sum(dtype=np.uint64).view(np.int64)), key.astype(">u8").tobytes()))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return (docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
            .mapInArrow(tidy(run), "id long, place int, n_words int, f1 long, f2 long, bands binary"))


def duplicate_paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80,
                         min_words: int = MIN_WORDS, rows: int = ROWS, miss: float = MISS) -> DataFrame:
    """(id, place, n_words, keep_id, keep_place): every paragraph and the paragraph
    that stays for its component, the first by id and place.  Paragraphs are
    linked if ``100 * common >= percent * union`` over their k-word shingles."""
    def linked(common, m, n):
        return 100 * common >= percent * (m + n - common)

    bands = bands_for(percent / 100, rows, miss)
    n = bands * rows
    least_equal = n * percent / 100 - _SLACK * (n * percent / 100 * (1 - percent / 100)) ** 0.5
    found = cut_lineage(_paragraphs(docs, id_col, text_col, k, min_words, bands, rows))
    first = found.groupBy("f1", "f2", "bands").agg(F.min(F.struct("id", "place")).alias("m"))
    # numbers of the different paragraphs; checkpointed, so they stay the same
    items = cut_lineage(first.select("f1", "f2", "bands", "m.id", "m.place", F.monotonically_increasing_id().alias("node")))
    keys = [F.concat(F.lit(bytes([b])), F.substring("bands", 8 * b + 1, 8)) for b in range(bands)]
    orders = items.select(F.explode(F.array(*keys)).alias("key"), "node")
    clusters = components(neighbours(orders, 9))
    size = clusters.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    wanted = (clusters.join(size, "component").join(items, "node")
              .groupBy("id").agg(F.collect_list(F.struct("place", "node", "component", "size")).alias("wanted")))    # bounded by the document's lines

    def sets(batches):
        import pyarrow as pa
        schema = pa.schema([("node", pa.int64()), ("component", pa.int64()), ("size", pa.int64()), ("sig", pa.binary()), ("shingles", pa.binary())])
        for b in batches:
            asked = b.column("wanted").to_pylist()
            for first, texts in text_slices(b, "text"):
                who, lines = [], []
                for i, t in enumerate(texts, first):
                    at = t.split(b"\n")
                    for w in asked[i]:
                        if w["place"] < len(at):
                            who.append(w)
                            lines.append(at[w["place"]])
                s = shingle_sets(lines, k)
                if who:
                    yield pa.RecordBatch.from_arrays(
                        [*(pa.array([w[c] for w in who], pa.int64()) for c in ("node", "component", "size")),
                         pa.array([minhash(x, n).astype(">u2").tobytes() for x in s], pa.binary()), pa.array([x.tobytes() for x in s], pa.binary())], schema=schema)

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    members = cut_lineage(texts.join(wanted, "id").mapInArrow(tidy(sets), "node long, component long, size long, sig binary, shingles binary")
                          .where("length(shingles) > 0"))
    same = components(confirmed_links(orders, members, [9], n, least_equal, linked))
    items = items.join(same, "node", "left").select("f1", "f2", "id", "place", F.coalesce("component", "node").alias("component"))
    keep = items.groupBy("component").agg(F.min(F.struct("id", "place")).alias("keep"))
    items = items.join(keep, "component").select("f1", "f2", "keep")
    return (found.select("id", "place", "n_words", "f1", "f2").join(items, ["f1", "f2"])
            .select("id", "place", "n_words", F.col("keep.id").alias("keep_id"), F.col("keep.place").alias("keep_place")))


def _removals(docs: DataFrame, id_col: str, text_col: str, **options) -> DataFrame:
    found = duplicate_paragraphs(docs, id_col, text_col, **options)
    gone = (F.col("id") != F.col("keep_id")) | (F.col("place") != F.col("keep_place"))
    return (found.select("id", "place", "n_words", gone.alias("gone")).distinct().groupBy("id")
            .agg(F.count(F.lit(1)).alias("n_paragraphs"), F.sum(F.col("gone").cast("long")).alias("n_removed"),
                 F.sum(F.when(F.col("gone"), F.col("n_words")).otherwise(0)).alias("n_removed_words"),
                 F.sort_array(F.collect_list(F.when(F.col("gone"), F.col("place")))).alias("removed")))     # bounded by the document's lines


def paragraph_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_paragraphs, n_removed, n_removed_words,
    removed (places of the lines that go, from 0, comma-joined).

    A null or empty text has no paragraphs, nor has a row without id; rows that
    share an id count as one document (the lines of its first text at a place).
    A paragraph repeated inside one document goes as well.  Other columns are
    ignored; an empty table gives an empty result."""
    r = _removals(docs, id_col, text_col, **options)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return (docs.select(F.col(id_col).alias("doc_id")).join(r, F.col("doc_id") == F.col("id"), "left")
            .select("doc_id", zero("n_paragraphs"), zero("n_removed"), zero("n_removed_words"), F.coalesce(F.array_join("removed", ","), F.lit("")).alias("removed")))


def without_repeated_paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with the lines that ``paragraph_report`` removes taken out of the text."""
    r = _removals(docs, id_col, text_col, **options).select(F.col("id").alias("_id"), "removed").where("size(removed) > 0")
    rows = docs.select(F.struct("*").alias("_row")).join(r, F.col(f"_row.`{id_col}`") == F.col("_id"), "left")
    rest = F.array_join(F.filter(F.split(F.col(f"_row.`{text_col}`"), "\n"), lambda x, i: ~F.array_contains(F.col("removed"), i)), "\n")
    return rows.select(*[F.when(F.col("removed").isNotNull(), rest).otherwise(F.col(f"_row.`{c}`")).alias(c) if c == text_col
                         else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
