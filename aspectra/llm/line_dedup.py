"""Lines that stand in many documents, found with levelled sorted runs.

A run is a bucketed, sorted table of 128-bit line hashes with the number of
documents that hold the line.  Each batch of documents is counted (once per
document, added up before the shuffle), merge-anti-joined with the runs, where
lines known to be common are settled, and added as a run of level 0.  When a
level holds two runs they are merged into one of the next level.  Runs and batches
share their buckets, so neither anti-joins nor merges shuffle a run.

Dropping the lines joins the places of common lines by hash.  Up to
``BROADCAST_ROWS`` common lines (16 bytes each) are broadcast; beyond that the few
lines that hold more than 1/HOT of a batch's lines are broadcast, and the rest,
which no key of can be large, are shuffled.  All of it is DataFrame functions.

Defined cases: every row is a document, rows that share an id or are equal too; a
null or empty text is one empty line; lines shorter than ``min_chars`` code points
after stripping are never counted nor dropped; a text of any length is one row of
hashes at a time; an empty table gives no rows; other columns, whatever their
names, pass through ``without_common_lines`` and are ignored by ``line_report``."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aspectra.llm.common import BROADCAST_ROWS
from aspectra.session import cut_lineage, scratch_path

MIN_DOCS = 10
MIN_CHARS = 1
BATCHES = 4                  # batches that a whole table is taken in
HOT = 10_000                 # a line of more than 1/HOT of a batch's lines is hot

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_KEY = ["h1", "h2"]
_ROW = ["r1", "r2"]


def lines_of(text: Column) -> Column:
    """The lines of a text; a null text is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends, A-Z lower-cased."""
    bare = F.btrim(line, F.lit(" \t\n\x0b\x0c\r"))
    ascii_only = F.octet_length(bare) == F.length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, _UPPER, _LOWER))


def _hashes(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("line"), key).alias("h2")]


def batch_keys(docs: DataFrame, batch: Column, min_chars: int = MIN_CHARS) -> DataFrame:
    """(batch, h1, h2, docs): how many documents of a batch hold each line."""
    keys = F.filter(F.array_distinct(F.transform(lines_of(F.col("text")), line_key)), lambda k: F.length(k) >= min_chars)
    rows = docs.select(batch.alias("batch"), F.explode(keys).alias("key")).select("batch", *_hashes(F.col("key")))
    return rows.groupBy("batch", *_KEY).agg(F.count(F.lit(1)).alias("docs"))


class LineRuns:
    """Levelled sorted runs of line hashes in a folder that all executors share."""

    def __init__(self, spark: SparkSession, min_docs: int = MIN_DOCS):
        self.spark, self.min_docs = spark, min_docs
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.folder = scratch_path(spark, "line-runs")
        self.hot: DataFrame | None = None

    def _write(self, rows: DataFrame, level: int) -> None:
        """One file a bucket: ``rows`` are already dealt by the hashes."""
        name = f"line_run_{uuid.uuid4().hex}"
        (rows.select(*_KEY, "docs").write.format("parquet").option("path", f"{self.folder}/{name}")
         .bucketBy(self.buckets, *_KEY).sortBy(*_KEY).saveAsTable(name))
        self.levels += [[] for _ in range(level + 1 - len(self.levels))]
        self.levels[level].append(name)

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def _merged(self, names: list[str]) -> DataFrame:
        """The merge join of runs.  (A union of bucketed scans would pass for dealt by the
        hashes in Spark 4.1, but isn't: sums over it come out wrong.)"""
        rows = self.spark.table(names[0])
        for name in names[1:]:
            other = self.spark.table(name).withColumnRenamed("docs", "more")
            docs = F.coalesce(F.col("docs"), F.lit(0)) + F.coalesce(F.col("more"), F.lit(0))
            rows = rows.join(other, _KEY, "full").select(*_KEY, docs.alias("docs"))
        return rows

    def add(self, keys: DataFrame) -> None:
        """Adds a batch (h1, h2, docs): lines that a run already knows to be common
        need no count any more, the others become a run of level 0."""
        total = F.lit(keys.agg(F.coalesce(F.sum("docs"), F.lit(0))).first()[0])
        hot = cut_lineage(keys.where(F.col("docs") * HOT >= total).select(*_KEY))
        self.hot = hot if self.hot is None else self.hot.union(hot)
        new = keys.repartition(self.buckets, *_KEY)
        for run in self.runs():
            new = new.join(run.where(F.col("docs") >= self.min_docs).select(*_KEY), _KEY, "left_anti")
        self._write(new, 0)
        level = 0
        while len(self.levels[level]) == 2:
            names = self.levels[level]
            self._write(self._merged(names), level + 1)
            self.levels[level] = []
            self._remove(names)
            level += 1

    def common(self) -> DataFrame:
        """(h1, h2) of the lines of at least ``min_docs`` documents."""
        names = [name for level in self.levels for name in level]
        return self._merged(names).where(F.col("docs") >= self.min_docs).select(*_KEY)

    def _remove(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE {name}")
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def close(self) -> None:
        """Removes all runs."""
        self._remove([name for level in self.levels for name in level])
        self.levels = []


def common_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS,
                 batches: int = BATCHES) -> tuple[DataFrame, DataFrame]:
    """(h1, h2) of the lines of at least ``min_docs`` documents, and of the hot lines.
    The table is read once and taken in batches by the hash of its rows."""
    batch = F.pmod(F.xxhash64("doc_id", "text"), F.lit(batches))
    staged = cut_lineage(batch_keys(docs.select("doc_id", "text"), batch, min_chars))
    runs = LineRuns(docs.sparkSession, min_docs)
    for b in range(batches):
        runs.add(staged.where(F.col("batch") == b).drop("batch"))
    common = cut_lineage(runs.common())
    runs.close()
    return common, runs.hot


def _places(docs: DataFrame, common: DataFrame, hot: DataFrame, min_chars: int, max_rows: int) -> DataFrame:
    """(r1, r2, places): where the texts of (r1, r2, text) hold common lines."""
    lines = docs.select(*_ROW, F.posexplode(F.transform(lines_of(F.col("text")), line_key)).alias("place", "key"))
    lines = lines.where(F.length("key") >= min_chars).select(*_ROW, "place", *_hashes(F.col("key")))
    if common.count() <= max_rows:
        found = lines.join(F.broadcast(common), _KEY)
    else:
        hot = common.join(F.broadcast(hot.distinct()), _KEY, "left_semi")
        cold = common.join(F.broadcast(hot), _KEY, "left_anti").withColumn("_cold", F.lit(True))
        lines = lines.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), _KEY, "left")
        # a hot line is settled: it goes anywhere, so no task gets all of its places
        lines = lines.withColumn("h1", F.when(F.col("_hot"), F.xxhash64("r1", "place")).otherwise(F.col("h1")))
        found = lines.join(cold, _KEY, "left").where(F.col("_hot") | F.col("_cold"))
    return found.groupBy(*_ROW).agg(F.collect_set("place").alias("places"))


def drop_lines(docs: DataFrame, common: DataFrame, hot: DataFrame, min_chars: int = MIN_CHARS,
               max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(row, text, n_lines, n_dropped): every row of ``docs`` as a struct, and its text
    without the common lines."""
    id_text = [F.col("row.doc_id"), F.col("row.text")]
    rows = docs.select(F.struct("*").alias("row"))
    # what goes depends on the text alone: rows equal in both may share their key
    rows = rows.select("row", F.xxhash64(*id_text).alias("r1"), F.xxhash64(F.lit("row"), *id_text).alias("r2"))
    places = _places(rows.select(*_ROW, F.col("row.text").alias("text")), common, hot, min_chars, max_rows)
    rows = rows.join(places, _ROW, "left").withColumn("lines", lines_of(F.col("row.text")))
    rows = rows.withColumn("n_lines", F.size("lines").cast("long")).withColumn("n_dropped", F.coalesce(F.size("places"), F.lit(0)).cast("long"))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("places"))
    rest = F.transform(F.array(F.col("lines")), lambda ls: F.array_join(F.transform(kept, lambda i: F.get(ls, i)), "\n"))
    text = F.when(F.col("places").isNull(), F.col("row.text")).otherwise(F.get(rest, F.lit(0)))
    return rows.select("row", text.alias("text"), "n_lines", "n_dropped")


def without_common_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with the same columns, ``text`` without the common lines."""
    common, hot = common_lines(docs, min_docs, min_chars)
    out = drop_lines(docs, common, hot, min_chars)
    return out.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])


def line_report(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_sha256 of every document."""
    docs = docs.select("doc_id", "text")
    common, hot = common_lines(docs, min_docs, min_chars)
    out = drop_lines(docs, common, hot, min_chars)
    return out.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped",
                      F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("kept_sha256"))
