"""Links inside bounded blocks: what the MinHash operators share.

Items (documents, paragraphs) come as rows (key, node), one per sorted order or
band.  Equal key prefixes make regions, regions make candidate clusters, and
links are confirmed on full shingle sets in blocks of at most BLOCK items."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aspectra.llm.common import components, release, spanning_links, tidy
from aspectra.session import cut_lineage

BLOCK = 512


def neighbours(orders: DataFrame, shared: int) -> DataFrame:
    """Candidate pairs of rows (key, node): neighbours in the sorted order whose
    keys share at least ``shared`` bytes.  The orders are range-partitioned (a hot region spreads over
    tasks); the ends of the partitions are linked in a second, small step."""
    def run(batches):
        import pyarrow as pa
        last = None
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("key", pa.binary())])
        for t in batches:
            if not t.num_rows:
                continue
            raw = t.column(0).to_pylist()
            key = np.frombuffer(b"".join(raw), np.uint8).reshape(len(raw), -1)[:, :shared]
            node = t.column(1).to_numpy(zero_copy_only=False)
            if last is None:
                yield pa.RecordBatch.from_arrays([pa.array([int(node[0])]), pa.nulls(1, pa.int64()), pa.array([raw[0]], pa.binary())], schema=schema)
            else:
                key, node = np.concatenate((last[0], key)), np.concatenate((last[1], node))
            same = np.flatnonzero((key[1:] == key[:-1]).all(axis=1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(node[same]), pa.array(node[same + 1]), pa.nulls(len(same), pa.binary())], schema=schema)
            last = key[-1:], node[-1:], raw[-1]
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([int(last[1][0])]), pa.nulls(1, pa.int64()), pa.array([last[2]], pa.binary())], schema=schema)

    from pyspark.sql import Window
    found = cut_lineage(orders.repartitionByRange("key", "node").sortWithinPartitions("key", "node")
                        .mapInArrow(tidy(run), "a long, b long, key binary"))
    w = Window.orderBy("key", "a")       # two rows per partition of the sort
    ends = (found.where("key is not null").select("a", "key")
            .select("a", F.lag("a").over(w).alias("b"), F.substring("key", 1, shared).alias("p"),
                    F.substring(F.lag("key").over(w), 1, shared).alias("q")))
    return (found.where("key is null").select("a", "b")
            .union(ends.where("b is not null and p = q").select("a", "b")))


def links_of_blocks(rows: DataFrame, n: int, least_equal: float, linked) -> DataFrame:
    """Links of blocks of members: rows (block, node, sig, shingles, asks);
    all of a block's members are compared if none asks, else those that ask
    with all.  Blocks are bounded (see BLOCK)."""
    def run(batches):
        import pyarrow as pa
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

        def links(rows):
            at = {}
            for node, sig, sh, asks in rows:       # a member can come twice: as member and asking
                at[node] = (sig, sh, asks or (at[node][2] if node in at else False))
            ids = list(at)
            if len(ids) < 2:
                return []
            sigs = np.frombuffer(b"".join(at[i][0] for i in ids), ">u2").reshape(len(ids), n)
            sets = [np.frombuffer(at[i][1], np.uint64) for i in ids]
            asking = [j for j, i in enumerate(ids) if at[i][2]]
            return [(ids[i], ids[j]) for i, j in spanning_links(ids, sets, sigs, least_equal, linked, asking or None)]

        def table(found):
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()),
                                               pa.array([x[1] for x in found], pa.int64())], schema=schema)

        block, held = None, []
        for t in batches:
            found = []
            for b, *row in zip(*(t.column(c).to_pylist() for c in ("block", "node", "sig", "shingles", "asks")), strict=True):
                if b != block:
                    found += links(held)
                    block, held = b, []
                held.append(row)
            if found:
                yield table(found)
        if found := links(held):
            yield table(found)

    return (rows.select("block", "node", "sig", "shingles", "asks")
            .repartition("block").sortWithinPartitions("block").mapInArrow(tidy(run), "a long, b long"))


def regions_of(orders: DataFrame, depths: list[int]) -> tuple[DataFrame, DataFrame]:
    """For the members of large clusters: (block, node) of the regions at adaptive
    depth, and (region, node, size) of large regions at the first depth.  A depth
    is a number of bytes of the key."""
    regions, wide, rest = None, None, orders
    for depth in depths:
        rest = rest.withColumn("region", F.substring("key", 1, depth))
        size = rest.groupBy("region").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
        at = cut_lineage(rest.join(size, "region"))
        rest = at.where(F.col("size") > BLOCK)
        wide = rest.select("region", "node", "size") if wide is None else wide
        done = at.where(F.col("size") <= BLOCK).select(F.col("region").alias("block"), "node")
        regions = done if regions is None else regions.union(done)
        if depth == depths[-1] or rest.isEmpty():
            break
        rest = rest.drop("region", "size")
    part = F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / BLOCK))
    split = rest.select(F.concat("region", F.lit(b"/"), part.cast("string").cast("binary")).alias("block"), "node")
    return regions.union(split), wide


def rest_of(large: DataFrame, comps: DataFrame) -> DataFrame:
    """(block, node, asks): members outside the main component of a large
    region, against all members of that region."""
    rows = (large.join(comps, large.node == comps.node, "left")
            .select("region", large.node, "size", F.coalesce("component", large.node).alias("component")))
    n = rows.groupBy("region", "component").agg(F.count(F.lit(1)).alias("n"))
    main = n.groupBy("region").agg(F.max(F.struct("n", "component")).alias("m"), F.sum("n").alias("all"))
    rows = (rows.join(main, "region")
            .withColumn("asks", F.col("component") != F.col("m.component"))
            .withColumn("parts", F.ceil(F.col("size") / BLOCK))
            .withColumn("groups", F.ceil((F.col("all") - F.col("m.n")) / BLOCK))
            .where("groups > 0"))
    own, h = F.pmod(F.xxhash64("node"), "parts"), F.pmod(F.xxhash64("node", F.lit(7)), "groups")
    grid = [(F.lit(False), F.array(own), F.sequence(F.lit(0).cast("long"), F.col("groups") - 1), rows),
            (F.lit(True), F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), F.array(h), rows.where("asks"))]
    out = None
    for asks, parts, groups, df in grid:
        df = (df.select("region", "node", asks.alias("asks"), F.explode(parts).alias("p"), groups.alias("g"))
              .select("region", "node", "asks", "p", F.explode("g").alias("g")))
        out = df if out is None else out.union(df)
    key = F.concat("region", F.concat_ws("/", F.lit(""), "p", "g").cast("binary"))
    return out.select(key.alias("block"), "node", "asks")


def confirmed_links(orders: DataFrame, members: DataFrame, depths: list[int], n: int, least_equal: float,
                    linked) -> DataFrame:
    """(a, b): links that span the components of all members.  ``members`` holds
    (node, component, size, sig, shingles) of the candidate clusters and is
    checkpointed, ``orders`` their keys."""
    links = links_of_blocks(members.where(f"size <= {BLOCK}").select(
        F.col("component").cast("string").cast("binary").alias("block"), "node", "sig", "shingles", F.lit(False).alias("asks")),
        n, least_equal, linked)
    large = members.where(f"size > {BLOCK}")
    if large.isEmpty():
        return links
    regions, wide = regions_of(orders.join(large.select("node").distinct(), "node", "left_semi").select("key", "node"), depths)
    deep = cut_lineage(links_of_blocks(regions.join(large, "node").withColumn("asks", F.lit(False)), n, least_equal, linked))
    del regions
    release(members.sparkSession)
    rest = links_of_blocks(rest_of(wide, components(deep)).join(large, "node"), n, least_equal, linked)
    return links.union(deep).union(rest)
