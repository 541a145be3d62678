"""Merkle manifest of a table: a tree per source, a tree over the sources, and for
every row the proof that leads from its leaf to the root.

Leaves get their place within the source from one range-partitioned sort.  Runs of
``FANOUT ** DEPTH`` leaves are aligned partitions: each builds its own subtree.  Then
the partitions exchange subtree roots like a butterfly: in round r, partitions at the
same offset of the ``FANOUT`` sibling subtrees form a group, swap the roots they hold
and all hash the parent, so each ends with its whole upper proof and no second pass
goes down the tree.  A last subtree with fewer partitions than its siblings speaks to
all offsets, its partitions by turns.  Each round is one shuffle of a row a partition
(a subtree of 2,187 leaves), keyed so that no group has more than ``FANOUT`` rows.  The
subroots of the sources are the leaves of the upper tree, built by the same functions.
Texts are hashed where they are read; only digests are shuffled.

Defined cases: a null is hashed as ``-``; rows without source form a source of their
own before all others; leaves ascend by doc_id, nulls first, equal ids by their leaf;
repeated rows are leaves of their own; a row without doc_id is never tampered with;
long texts stay where they are; an empty table gives no rows; columns other than the
five hashed ones are ignored, whatever their names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aspectra.llm.common import broadcast_checked
from aspectra.session import cut_lineage

FANOUT = 3
DEPTH = 7                    # levels of the subtree that one partition builds alone
BROADCAST_PARTS = 20_000     # places of subtrees and sources, below 2 KB a row
_ROUNDS_A_CUT = 4

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def field(c: Column) -> Column:
    """``-`` for a null, else UTF-8 byte count, ``:`` and the value."""
    v = c.cast("string")
    return F.when(v.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v))


def leaf_of(row: dict[str, Column]) -> Column:
    """The digest of a row given by its columns."""
    return F.sha2(F.concat(*[field(row[c]) for c in COLUMNS]), 256)


def _div(a: Column, b) -> Column:
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b))


def _nodes(n: Column, level: int) -> Column:
    """Nodes that n leaves have on a level."""
    return _div(n + (FANOUT ** level - 1), FANOUT ** level)


def placed(leaves: DataFrame) -> DataFrame:
    """Adds ``at``, the place of each row within its ``tree`` (from 0, by ``key`` and
    ``leaf``, nulls first), and ``n``, the rows of the tree.  One sort by ranges that
    splits a tree of any size; the counts by range and tree give the offsets."""
    leaves = cut_lineage(leaves)                     # the sort looks twice, the texts are read once
    ranged = leaves.repartitionByRange(F.col("tree"), F.col("key").asc_nulls_first(), F.col("leaf"))
    ranged = ranged.sortWithinPartitions(F.col("tree"), F.col("key").asc_nulls_first(), F.col("leaf"))
    # the id counts the rows of a range in order; its upper bits number the ranges
    ranged = cut_lineage(ranged.withColumn("_id", F.monotonically_increasing_id()).withColumn("_range", F.shiftright("_id", 33)))
    counts = ranged.groupBy("tree", "_range").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    by_tree = Window.partitionBy("tree")
    before = by_tree.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("tree", "_range", "_first", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"),
                           F.sum("_rows").over(by_tree).alias("n"))
    out = ranged.join(broadcast_checked(counts), ["tree", "_range"])
    return out.withColumn("at", F.col("_id") - F.col("_first") + F.col("_before")).drop("_id", "_range", "_first", "_before")


def _parents(nodes: Column) -> Column:
    """The digests of the runs of FANOUT consecutive nodes."""
    runs = F.sequence(F.lit(0), (_nodes(F.size(nodes), 1) - 1).cast("int"))
    return F.transform(runs, lambda r: F.sha2(F.array_join(F.slice(nodes, r * FANOUT + 1, FANOUT), ""), 256))


def _levels(leaves: Column, height: Column) -> Column:
    """The nodes of a subtree level by level, ``height`` levels above the leaves."""
    steps = F.filter(F.sequence(F.lit(0), height), lambda i: i > 0)
    return F.aggregate(steps, F.array(leaves), lambda done, _: F.concat(done, F.array(_parents(F.element_at(done, -1)))))


def _siblings(levels: Column, at: Column) -> Column:
    """The siblings before and after a leaf's ancestors, level by level."""
    def step(level, height):
        place = _div(at, F.pow(F.lit(FANOUT), height).cast("long")).cast("int")
        first = place - F.pmod(place, F.lit(FANOUT))
        return F.struct(F.array_join(F.slice(level, first + 1, place - first), "").alias("left"),
                        F.array_join(F.slice(level, place + 2, F.lit(FANOUT) - 1 - (place - first)), "").alias("right"))
    return F.transform(F.slice(levels, F.lit(1), F.size(levels) - 1), step)


def _swap(parts: DataFrame, r: int) -> DataFrame:
    """Round r: partitions (tree, part, parts, top, path) get the siblings of the subtree
    root they hold and hash the parent; trees with a single root are left as they are."""
    width = FANOUT ** r
    node, offset = _div(F.col("part"), width), F.pmod(F.col("part"), F.lit(width))
    size = F.least(F.lit(width), F.col("parts") - node * width)      # partitions of its subtree
    active = F.when(F.col("parts") > width, F.sequence(offset, F.lit(width - 1), size)).otherwise(F.array(offset))
    said = parts.select("*", node.alias("_node"), offset.alias("_own"), F.explode(active).alias("_offset"))
    run = _div(F.col("_node"), FANOUT)
    member = F.struct("_node", "top", (F.col("_offset") == F.col("_own")).alias("real"), "part", "path")
    groups = said.groupBy("tree", "parts", run.alias("_run"), "_offset").agg(F.sort_array(F.collect_list(member)).alias("_all"))
    groups = groups.select("tree", "parts", "_all", F.explode("_all").alias("_me")).where("_me.real")

    def beside(before: bool) -> Column:
        mine = F.filter("_all", lambda m: (m["_node"] < F.col("_me._node")) if before else (m["_node"] > F.col("_me._node")))
        return F.array_join(F.transform(mine, lambda m: m["top"]), "")

    step = F.struct(beside(True).alias("left"), beside(False).alias("right"))
    going = F.col("parts") > width
    top = F.sha2(F.array_join(F.transform("_all", lambda m: m["top"]), ""), 256)
    return groups.select("tree", "parts", F.col("_me.part").alias("part"),
                         F.when(going, top).otherwise(F.col("_me.top")).alias("top"),
                         F.when(going, F.concat("_me.path", F.array(step))).otherwise(F.col("_me.path")).alias("path"))


def upper_paths(parts: DataFrame) -> DataFrame:
    """(tree, part, top, path): the root of the tree that partitions (tree, part, parts,
    top) belong to, and the siblings on the way to it."""
    most = parts.agg(F.max("parts")).first()[0] or 1
    parts = parts.withColumn("path", F.expr("cast(array() as array<struct<left:string,right:string>>)"))
    r = 0
    while FANOUT ** r < most:
        parts = _swap(parts, r)
        r += 1
        if r % _ROUNDS_A_CUT == 0:
            parts = cut_lineage(parts)
    return parts.select("tree", "part", "top", "path")


def trees(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Trees over ``leaves`` (tree string, key, leaf, more): a row a partition with its
    members (structs of the leaves), levels, top and the siblings of its root (path);
    and a row a tree with its root (top)."""
    rows = placed(leaves)
    rest = [c for c in rows.columns if c not in ("tree", "n", "at")]
    rows = rows.groupBy("tree", "n", _div(F.col("at"), FANOUT ** DEPTH).alias("part")).agg(
        F.sort_array(F.collect_list(F.struct("at", *rest))).alias("members"))
    # levels above the leaves while the tree has more than one node, at most DEPTH
    height = sum(((_nodes(F.col("n"), level) > 1).cast("int") for level in range(DEPTH)), F.lit(0))
    rows = rows.withColumn("levels", _levels(F.transform("members", lambda m: m["leaf"]), height))
    rows = cut_lineage(rows.withColumn("parts", _nodes(F.col("n"), DEPTH)))
    tops = rows.select("tree", "part", "parts", F.get(F.element_at("levels", -1), F.lit(0)).alias("top"))
    upper = cut_lineage(upper_paths(tops))
    rows = rows.drop("parts").join(upper, ["tree", "part"])
    return rows, upper.where("part = 0").select("tree", "top")


def member_paths(rows: DataFrame, *more: str) -> DataFrame:
    """A row a member of ``trees``: ``member``, ``top``, ``path`` (the siblings of its leaf's
    ancestors up to the root of the tree) and further columns.  The paths are put
    together inside the partition's row, so its levels aren't copied for every member."""
    def with_path(m):
        inside = F.pmod(m["at"], F.lit(FANOUT ** DEPTH))
        return F.struct(m.alias("member"), F.concat(_siblings(F.col("levels"), inside), F.col("path")).alias("path"))

    return rows.select("tree", "top", *more, F.inline(F.transform("members", with_path)))


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))


def manifest(docs: DataFrame, other_leaf: Column | None = None) -> DataFrame:
    """(doc_id, leaf, other, subroot, root, path) of every row; ``other`` is a second
    digest of the row, given as a column over ``docs`` (default: the leaf)."""
    leaf = leaf_of({c: F.col(c) for c in COLUMNS})
    # a key that orders sources bytewise, null first, and is never null
    tree = F.coalesce(F.concat(F.lit("s"), "source"), F.lit(""))
    leaves = docs.select(tree.alias("tree"), F.col("doc_id").alias("key"), leaf.alias("leaf"),
                         (leaf if other_leaf is None else other_leaf).alias("other"))
    rows, subroots = trees(leaves)
    sources, root = trees(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("key"), F.col("top").alias("leaf")))
    sources = member_paths(sources).select(F.col("member.key").alias("tree"), F.col("top").alias("root"), F.col("path").alias("over"))
    rows = member_paths(rows.join(broadcast_checked(sources, BROADCAST_PARTS), "tree"), "root", "over")
    return rows.select(F.col("member.key").alias("doc_id"), "member.leaf", "member.other", F.col("top").alias("subroot"), "root",
                       F.concat("path", "over").alias("path"))


def tampered_leaf(every: int = 2) -> Column:
    """The digest of a row whose text lost its line ends, where ``every`` divides the
    CRC-32 of the id; the leaf elsewhere."""
    row = {c: F.col(c) for c in COLUMNS}
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % every == 0, F.lit(False))
    row["text"] = F.when(hit, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return leaf_of(row)


def tamper_report(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root and proof of the table, and whether the leaf that a
    reader of the tampered table finds still leads to the root."""
    rows = manifest(docs, tampered_leaf())
    proof = F.sha2(F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), ""), 256)
    return rows.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), fold(F.col("other"), F.col("path")).alias("folded_root")) \
        .withColumn("verified", F.col("folded_root") == F.col("root"))
