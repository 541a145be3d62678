"""Stage tables: scans with required columns, and the sinks of each stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from aspectra.operators.labeling import assert_columns

REVIEW_SCHEMA = T.StructType([
    T.StructField("review_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("aspect", T.StringType()), T.StructField("polarity", T.StringType()),
    T.StructField("lang", T.StringType()),
])
REQUIRED = ("text", "polarity", "lang")


def write_corpus(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                 partition_by=("lang",)) -> str:
    """Publish a stage table, partitioned by language so later filters on
    ``lang`` prune whole folders.  CSV is available for interchange."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        # the CSV writer trims values unless told otherwise: keep text exact
        (w.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False)
          .option("ignoreTrailingWhiteSpace", False).csv(path))
    else:
        w.format(fmt).save(path)
    return path


def scan_corpus(spark: SparkSession, path: str, fmt: str = "parquet", schema=None,
                required=REQUIRED) -> DataFrame:
    """Load a stage table and require ``text, polarity, lang``."""
    r = spark.read.format(fmt)
    if schema is not None:
        r = r.schema(schema)
    if fmt == "csv":
        r = r.option("header", True).option("multiLine", True).option("escape", '"')
    return assert_columns(r.load(path), required)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence check through the cluster file system (any Hadoop scheme)."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return bool(fs.exists(p))


def scan_first_available(spark: SparkSession, paths, fmt: str = "parquet", **kw) -> DataFrame:
    """Scan the first existing dataset of a priority list; error if none."""
    for p in paths:
        if path_exists(spark, p):
            return scan_corpus(spark, p, fmt, **kw)
    raise FileNotFoundError(f"none of the datasets exists: {list(paths)}")


def write_matrix(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """A matrix is a few rows: one CSV file with header."""
    (df.coalesce(1).write.mode(mode).option("header", True).option("escape", '"')
       .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    return path


def write_report(lines: DataFrame, path: str, mode: str = "overwrite") -> str:
    lines.coalesce(1).write.mode(mode).text(path)
    return path
