"""Helpers shared by the operators of this subpackage: hashing of texts inside
Arrow batches (numpy, no per-word Python) and connected components."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aspectra.session import cut_lineage

SLICE_BYTES = 1 << 18        # text handled at once inside a task; numpy takes about 100 times as much


def give_back() -> None:
    """Returns memory that numpy and Arrow have freed to the system.  Python workers are
    kept for later tasks; what one stage has freed would count for all stages after it."""
    import ctypes

    import pyarrow as pa
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)      # glibc only
    if trim is not None:
        trim(0)


def tidy(run):
    """A mapInArrow function that gives freed memory back at its end."""
    def out(batches):
        try:
            yield from run(batches)
        finally:
            give_back()
    return out


def _odd(seed: int, n: int) -> np.ndarray:
    """n fixed odd 64-bit constants."""
    return np.random.default_rng(seed).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_STEP = 0x9E3779B97F4A7C15
_STEP_INV = pow(_STEP, -1, 1 << 64)
_BYTE = _odd(11, 256)


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    p[:1] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(p, dtype=np.uint64)


def byte_prefix(data: np.ndarray):
    """(prefix sums of byte codes times powers, inverse powers): the hash of
    data[i:j] is (prefix[j] - prefix[i]) * inverse[i], wrapping at 2**64."""
    n = len(data)
    out = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * _powers(_STEP, n), out=out[1:])
    return out, _powers(_STEP_INV, n + 1)


def word_hashes(texts: list[bytes]):
    """Hashes of the words (runs without ASCII white space, A-Z lower-cased) of
    all texts, and the n + 1 bounds of each text's words."""
    buf = np.frombuffer(b"\n".join(texts).lower(), np.uint8)
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=at[1:])
    word = ~((buf == 32) | ((buf >= 9) & (buf <= 13)))
    edge = np.diff(np.concatenate(([0], word.view(np.int8), [0])))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    prefix, inverse = byte_prefix(buf)
    h = mix64((prefix[ends] - prefix[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    return h, np.searchsorted(starts, at)


def sequence_hashes(texts: list[bytes]) -> np.ndarray:
    """One hash per text of its words in order."""
    h, bounds = word_hashes(texts)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix64(h) * _powers(_STEP, len(h)))))
    inverse = _powers(_STEP_INV, len(h) + 1)
    return mix64((sums[bounds[1:]] - sums[bounds[:-1]]) * inverse[bounds[:-1]] + np.diff(bounds).astype(np.uint64))


_PLACE = _odd(12, 64)


def shingle_sets(texts: list[bytes], k: int = 5):
    """One sorted array of distinct hashes per text: its k-word shingles, or the
    whole word sequence when it has fewer words; empty without words."""
    h, bounds = word_hashes(texts)
    n = len(h)
    full = np.zeros(max(0, n - k + 1), np.uint64)
    for j in range(k if n >= k else 0):
        full += h[j:n - k + 1 + j] * _PLACE[j]
    full = mix64(full)
    out = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= k:
            out.append(np.unique(full[a:b - k + 1]))
        elif b > a:
            out.append(mix64((h[a:b] * _PLACE[:b - a]).sum(keepdims=True) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


_A, _B = (_odd(13, 512) >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (_odd(14, 512) >> np.uint64(32)).astype(np.uint32)


def minhash(shingles: np.ndarray, n: int) -> np.ndarray:
    """n min-wise hashes of a set, folded to 16 bits each."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    low = np.full(n, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 2048):
        np.minimum(low, (x[None, i:i + 2048] * _A[:n, None] + _B[:n, None]).min(axis=1), out=low)
    return ((low * np.uint32(2654435761)) >> np.uint32(16)).astype(np.uint16)


def text_slices(batch, column: str):
    """(first row, texts as bytes) of slices of at most SLICE_BYTES of text (one
    long text makes its own slice); a null text counts as empty."""
    import pyarrow as pa
    texts = batch.column(column).cast(pa.binary()).to_pylist()
    first, size, part = 0, 0, []
    for i, t in enumerate(texts):
        t = t or b""
        if part and size + len(t) > SLICE_BYTES:
            yield first, part
            first, size, part = i, 0, []
        part.append(t)
        size += len(t)
    if part:
        yield first, part


def _contract(edges: DataFrame) -> DataFrame:
    """Edges (x, y) with x > y that join the same nodes: in each partition every
    node points to the smallest node it reaches there."""
    def run(batches):
        import pyarrow as pa
        parent: dict = {}

        def find(x):
            root = x
            while parent[root] != root:
                root = parent[root]
            while parent[x] != root:
                parent[x], x = root, parent[x]
            return root

        for b in batches:
            for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True):
                if x is None or y is None or x == y:
                    continue
                parent.setdefault(x, x)
                parent.setdefault(y, y)
                x, y = find(x), find(y)
                if x != y:
                    parent[max(x, y)] = min(x, y)
        nodes = [x for x in parent if parent[x] != x]
        for i in range(0, len(nodes), 50_000):
            part = nodes[i:i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([find(x) for x in part], pa.int64())], names=["x", "y"])

    return edges.select("x", "y").mapInArrow(tidy(run), "x long, y long")


FEW_EDGES = 200_000          # remaining edges that one partition contracts at once


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of the nodes of an edge list of longs; the component is
    its smallest node.  Partitions first contract their own edges, then large and
    small stars alternate: each round is two partial minima, two joins and a
    distinct of the shrinking edge list, checkpointed.  The rounds end when nothing
    changes, or when at most FEW_EDGES edges are left.  Nothing but a count and a
    checksum reaches the driver."""
    def digest(df):
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("x", "y").cast("decimal(20,0)"))).first())

    e = cut_lineage(_contract(edges.select(F.col(a).alias("x"), F.col(b).alias("y"))).distinct())
    seen = digest(e)
    while seen[0] > FEW_EDGES:
        both = e.union(e.select(F.col("y").alias("x"), F.col("x").alias("y")))
        low = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.join(low, "x").where("y > x").select(F.col("y").alias("x"), F.col("m").alias("y"))
        low = large.groupBy("x").agg(F.min("y").alias("m"))
        small = large.join(low, "x").where("y > m").select(F.col("y").alias("x"), F.col("m").alias("y"))
        e = cut_lineage(_contract(small.union(low.select("x", F.col("m").alias("y")))).distinct())
        del both, low, large, small
        release(edges.sparkSession)
        now = digest(e)
        if now == seen:
            break
        seen = now
    else:
        # what is left fits one partition (16 bytes an edge): contracting that ends it
        e = cut_lineage(_contract(e.coalesce(1)))
    roots = e.select(F.col("y").alias("node"), F.col("y").alias("component")).distinct()
    return e.withColumnsRenamed({"x": "node", "y": "component"}).union(roots)


def spanning_links(ids, sets, sigs, least_equal: float, linked, rows=None):
    """Links (as index pairs) that span the components of one bounded block of
    sets.  Pairs whose signatures agree in fewer than least_equal places are
    passed over, the rest is decided by linked(common, size_a, size_b) on the
    full sets; pairs already connected are not looked at again.  With ``rows``,
    only pairs that hold one of these indices are compared."""
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    sizes = np.array([len(s) for s in sets], np.int64)
    out = []
    for i in (range(len(ids)) if rows is None else rows):
        lo = i + 1 if rows is None else 0
        near = np.flatnonzero((sigs[i] == sigs[lo:]).sum(axis=1) >= least_equal) + lo
        near = near[linked(np.minimum(sizes[near], sizes[i]), sizes[near], sizes[i])] if len(near) else near
        for j in near:
            if j == i or find(i) == find(j):
                continue
            common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if linked(common, sizes[i], sizes[j]):
                parent[find(i)] = find(j)
                out.append((i, int(j)))
    return out


BROADCAST_ROWS = 100_000


def broadcast_checked(small: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``small`` marked for broadcast if it has at most ``max_rows`` (narrow) rows,
    counted first; else as it is, so the join is shuffled (and split on skew)."""
    small = cut_lineage(small)
    return F.broadcast(small) if small.count() <= max_rows else small


def release(spark) -> None:
    """Lets Spark's cleaner remove the shuffle files and checkpoints of finished
    phases: it does so when their handles are collected on the driver."""
    import gc
    gc.collect()
    spark.sparkContext._jvm.System.gc()
