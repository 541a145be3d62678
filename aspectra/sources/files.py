"""The heads of files as a table, and the route that each input file takes.

``file_heads`` is a data source: the files are listed once, and tasks read the first
characters of their share of them, whatever the size of the files.  Any store that
Arrow's file systems reach will do."""

from __future__ import annotations

from urllib.parse import quote, unquote, urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

HEAD_CHARS = 500
FILES_PER_TASK = 256
#: FIXED VALUES: marks of the opinion layout, and of French and Russian files.
OPINION_MARKS = ["<Reviews>", "<Opinion"]
FRENCH_NAME = "fr"
RUSSIAN_NAME = "rusentiment"


def _store(uri: str):
    """(file system, path, prefix of the paths as Spark writes them)."""
    from pyarrow import fs
    where = urlparse(uri)
    if where.scheme in ("", "file"):
        return fs.LocalFileSystem(), unquote(where.path), "file://"
    store, path = fs.FileSystem.from_uri(uri)
    return store, path, f"{where.scheme}://" + ("" if path.startswith(where.netloc + "/") else where.netloc)


class _Files(InputPartition):
    def __init__(self, paths):
        self.paths = paths


class _HeadReader(DataSourceReader):
    def __init__(self, options):
        self.uri, self.chars = options["path"], int(options.get("chars", HEAD_CHARS))

    def partitions(self):
        from pyarrow import fs
        store, path, _ = _store(self.uri)
        info = store.get_file_info(path)
        found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(path, recursive=True))
        paths = sorted(f.path for f in found if f.type == fs.FileType.File and f.base_name[:1] not in "._")
        return [_Files(paths[i:i + FILES_PER_TASK]) for i in range(0, len(paths), FILES_PER_TASK)] or [_Files([])]

    def read(self, partition):
        store, _, prefix = _store(self.uri)
        for path in partition.paths:
            with store.open_input_stream(path) as f:
                # a character has at most four bytes; the last one may be cut
                head = f.read(4 * self.chars).decode("utf-8", "replace")[:self.chars]
            yield prefix + quote(path, safe="/:@!$&'()*+,;=~"), head


class FileHeads(DataSource):
    @classmethod
    def name(cls):
        return "file_heads"

    def schema(self):
        return "file string, head string"

    def reader(self, schema):
        return _HeadReader(self.options)


def file_heads(spark: SparkSession, path: str, chars: int = HEAD_CHARS) -> DataFrame:
    """(file, head): the files below ``path`` and their first characters."""
    spark.dataSource.register(FileHeads)
    return spark.read.format("file_heads").option("chars", chars).load(path).withColumn("file", file_key(F.col("file")))


def file_key(path: Column) -> Column:
    """A file's path with one way of writing the scheme (``file:/a``, ``file:///a``)."""
    return F.regexp_replace(path, r"^(\w+):/+", "$1:/")


def file_name(file: Column) -> Column:
    """The name of an input: that of the file, or of the folder (the value of a
    ``key=value`` folder) for the parts that Spark writes into one."""
    name = F.element_at(F.split(file, "/"), -1)
    folder = F.regexp_replace(F.get(F.split(file, "/"), F.size(F.split(file, "/")) - 2), r"^[^=]*=", "")
    return F.when(name.startswith("part-"), folder).otherwise(name)


def routes(heads: DataFrame) -> DataFrame:
    """(file, format, layout, lang) of the files that are read; other formats are left
    out.  XML files are of the opinion layout, always French, if their head shows it;
    else of the term layout, French if the name holds ``fr`` in any case, else English.
    CSV files are Russian by name, else English."""
    name = F.lower(file_name(F.col("file")))
    suffix = F.substring_index(F.col("file"), ".", -1)
    opinion = F.lit(False)
    for mark in OPINION_MARKS:
        opinion = opinion | F.contains(F.col("head"), F.lit(mark))
    layout = F.when(suffix == "csv", "csv").when(opinion, "opinion").otherwise("term")
    lang = (F.when((suffix == "csv") & F.contains(name, F.lit(RUSSIAN_NAME)), "ru")
            .when((suffix == "xml") & (opinion | F.contains(name, F.lit(FRENCH_NAME))), "fr").otherwise("en"))
    return heads.where(suffix.isin("xml", "csv")).select("file", suffix.alias("format"), layout.alias("layout"), lang.alias("lang"))
