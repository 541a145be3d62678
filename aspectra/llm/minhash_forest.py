"""Near duplicates by an LSH forest of MinHash signatures.

Every document gets ``TREES`` short signatures.  For each tree all signatures
are sorted; documents next to each other in an order whose longest common
prefix reaches ``BASE`` values are candidates.  Runs of such neighbours make
regions, and the regions of all trees make candidate clusters.  Inside them,
links are confirmed on the full shingle sets:

* a cluster of at most ``BLOCK`` documents is compared as one block;
* a larger one is cut by the forest: in each tree, a region goes as deep as is
  needed to hold at most ``BLOCK`` documents;
* documents that are still apart from the main component of a large region are
  then compared with all documents of the region, in blocks, so no region loses
  a link to its depth.

Only links that join two components of a block are written, so a group of n
near copies costs about n links per tree, never n * n.  Documents with equal
sets are one node throughout.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aspectra.llm.blocks import BLOCK, confirmed_links, neighbours
from aspectra.llm.common import components, minhash, mix64, release, shingle_sets, text_slices, tidy
from aspectra.session import cut_lineage

TREES, DEPTH, BASE = 16, 8, 4
N = TREES * DEPTH
_SLACK = 5.0                 # standard deviations that a signature may fall short

_SIG = "doc_id long, n_shingles long, f1 long, f2 long, sig binary"
_SET = "node long, component long, sig binary, shingles binary"


def _signature(s: np.ndarray) -> bytes:
    return minhash(s, N).astype(">u2").tobytes() if len(s) else b""


def signatures(docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """One row per document: size and 128-bit fingerprint of its shingle set, and
    the signatures of all trees."""
    def run(batches):
        import pyarrow as pa
        salt = np.uint64(0xD6E8FEB86659FD93)
        for b in batches:
            ids, out = b.column(0).to_pylist(), [[], [], [], [], []]
            for first, texts in text_slices(b, "text"):
                for i, s in enumerate(shingle_sets(texts, k), first):
                    f1, f2 = mix64(s).sum(dtype=np.uint64), mix64(s ^ salt).sum(dtype=np.uint64)
                    for col, v in zip(out, (ids[i], len(s), int(f1.view(np.int64)), int(f2.view(np.int64)),
                                            _signature(s)), strict=True):
                        col.append(v)
            if ids:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(out, [pa.int64()] * 4 + [pa.binary()], strict=True)],
                    names=["doc_id", "n_shingles", "f1", "f2", "sig"])

    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
            .mapInArrow(tidy(run), _SIG))


def _orders(nodes: DataFrame) -> DataFrame:
    """(key, node): one row per tree, the key is the tree and its signature."""
    keys = [F.concat(F.lit(bytes([t])), F.substring("sig", 2 * DEPTH * t + 1, 2 * DEPTH)) for t in range(TREES)]
    return nodes.select(F.explode(F.array(*keys)).alias("key"), "node")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5,
                    percent: int = 85) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Two documents are linked if ``100 * common >= percent * union`` over their
    sets of k-word shingles (A-Z lower-cased; a shorter text is one shingle).
    The component_id is the smallest doc_id reachable through links, kept marks
    that document.  A text that is null, empty or without words has no
    shingles, is linked with nothing and is kept.  Rows without doc_id are kept
    and get no component; rows that share a doc_id count as one document (their
    links are joined).  Other columns are ignored; an empty table gives none."""
    def linked(common, m, n):
        return 100 * common >= percent * (m + n - common)

    j = percent / 100
    least_equal = N * j - _SLACK * (N * j * (1 - j)) ** 0.5
    sigs = cut_lineage(signatures(docs, id_col, text_col, k))
    classes = (sigs.where("n_shingles > 0").groupBy("f1", "f2", "n_shingles", "sig")
               .agg(F.min("doc_id").alias("node")))
    nodes = cut_lineage(classes.where("node is not null"))
    orders = _orders(nodes)
    clusters = components(neighbours(orders, 1 + 2 * BASE))
    size = clusters.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    clusters = clusters.join(size, "component")

    def sets(batches):
        import pyarrow as pa
        for b in batches:
            for first, texts in text_slices(b, "text"):
                n = len(texts)
                found = shingle_sets(texts, k)
                yield pa.RecordBatch.from_arrays(
                    [b.column("node").slice(first, n), b.column("component").slice(first, n), b.column("size").slice(first, n),
                     pa.array([_signature(s) for s in found], pa.binary()),
                     pa.array([s.tobytes() for s in found], pa.binary())],
                    names=["node", "component", "size", "sig", "shingles"])

    texts = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).cast("string").alias("text"))
    held = cut_lineage(texts.join(clusters, "node").mapInArrow(tidy(sets), _SET.replace("component long", "component long, size long"))
                       .where("length(shingles) > 0"))
    del clusters, size
    release(docs.sparkSession)
    links = confirmed_links(orders, held, [1 + 2 * d for d in range(BASE, DEPTH + 1)], N, least_equal, linked)
    found = components(links)
    ids = nodes.join(found, "node", "left").select("f1", "f2", "n_shingles", F.coalesce("component", "node").alias("component"))
    key = [sigs.f1 == ids.f1, sigs.f2 == ids.f2, sigs.n_shingles == ids.n_shingles]
    component = F.when(sigs.doc_id.isNull() | (sigs.n_shingles == 0), sigs.doc_id).otherwise(F.coalesce(ids.component, sigs.doc_id))
    return (sigs.join(ids, key, "left")
            .select(sigs.doc_id, sigs.n_shingles, component.alias("component_id"),
                    sigs.doc_id.eqNullSafe(component).alias("kept")))
