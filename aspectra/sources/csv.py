"""Labelled CSV reader (one text column, one label column)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aspectra import dicts
from aspectra.functions import labels as L
from aspectra.functions.text import py_strip
from aspectra.session import MAX_BROADCAST_ROWS
from aspectra.sources.files import file_key


def detect_columns(columns) -> tuple[str | None, str | None]:
    """Case-insensitive choice of the text and label columns among the
    candidate names; when several match, the last one wins.  Schema-level:
    no job runs."""
    text_col = label_col = None
    for c in columns:
        lc = c.lower()
        if lc in dicts.CSV_TEXT_COLUMNS:
            text_col = c
        if lc in dicts.CSV_LABEL_COLUMNS:
            label_col = c
    return text_col, label_col


def read_csv_raw(spark: SparkSession, path, encoding: str = "UTF-8") -> DataFrame:
    """Header CSV, quoted multi-line values, all columns as strings.
    Encoding is explicit (UTF-8 by default); windows-1251 needs
    ``spark.sql.legacy.javaCharsets=true`` on Spark 4."""
    return (spark.read.option("header", True).option("multiLine", True)
            .option("escape", '"').option("encoding", encoding).csv(path))


#: Encodings that a file may be tried for, the strictest first.  The original's order
#: takes nearly every UTF-8 file for windows-1251; pass ORIGINAL_ORDER to get that.
ENCODINGS = ("utf-8", "windows-1251", "iso-8859-1")
ORIGINAL_ORDER = ("windows-1251", "utf-8", "iso-8859-1")

# the upper halves of two single-byte encodings, character by character
_UPPER_LATIN = "".join(chr(c) for c in range(128, 256))
_UPPER_1251 = bytes(range(128, 256)).decode("cp1251", "replace")

#: what a file's bytes must fulfil line by line, and how they are read
_VALID = {
    "utf-8": lambda line: F.is_valid_utf8(line),
    "windows-1251": lambda line: ~F.contains(line.cast("binary"), F.lit(b"\x98")),      # its only unused byte
    "iso-8859-1": lambda line: F.lit(True),
}
_DECODE = {
    "utf-8": lambda b: F.decode(b, "UTF-8"),
    "windows-1251": lambda b: F.translate(F.decode(b, "ISO-8859-1"), _UPPER_LATIN, _UPPER_1251),
    "iso-8859-1": lambda b: F.decode(b, "ISO-8859-1"),
}


def _folder(spark: SparkSession, path):
    return spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv")


def file_encodings(spark: SparkSession, path, encodings=ENCODINGS) -> DataFrame:
    """(file, encoding): for each file the first of ``encodings`` that all its bytes are
    valid in (null if none is).  One scan of the lines' bytes, one row per file and task."""
    lines = _folder(spark, path).text(path).select(file_key(F.col("_metadata.file_path")).alias("file"), "value")
    valid = lines.groupBy("file").agg(*[F.bool_and(_VALID[e](F.col("value"))).alias(f"_{i}") for i, e in enumerate(encodings)])
    first = F.coalesce(*[F.when(F.col(f"_{i}"), e) for i, e in enumerate(encodings)])
    return valid.select("file", first.alias("encoding"))


def read_csv_decoded(spark: SparkSession, path, encodings=ENCODINGS) -> DataFrame:
    """Header CSV files of one layout, each in its own encoding.  All are parsed byte for
    byte as ISO-8859-1, whose commas, quotes and line ends are those of every candidate;
    then each cell gets its file's encoding.  Files that no candidate fits are left out."""
    raw = _folder(spark, path).option("header", True).option("multiLine", True).option("escape", '"').option("encoding", "ISO-8859-1").csv(path)
    # a byte order mark, read as ISO-8859-1
    names = [c.removeprefix("\u00ef\u00bb\u00bf") for c in raw.columns]
    cells = raw.select(file_key(F.col("_metadata.file_path")).alias("_file"), *[F.col(f"`{c}`").alias(n) for c, n in zip(raw.columns, names, strict=True)])
    found = file_encodings(spark, path, encodings).withColumnsRenamed({"file": "_file", "encoding": "_encoding"})
    few = len(raw.inputFiles()) <= MAX_BROADCAST_ROWS               # the listing bounds the table
    cells = cells.join(F.broadcast(found) if few else found, "_file")

    def decoded(c: str) -> Column:
        b = F.encode(F.col(f"`{c}`"), "ISO-8859-1")
        return F.coalesce(*[F.when(F.col("_encoding") == e, _DECODE[e](b)) for e in encodings]).alias(c)

    return cells.where(F.col("_encoding").isNotNull()).select(*[decoded(n) for n in names])


def has_csv(spark: SparkSession, path) -> bool:
    """Whether a CSV file is listed below ``path``."""
    return bool(spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").load(path).inputFiles())


def read_labelled_csv(spark: SparkSession, path, encoding: str | tuple = "UTF-8",
                      lang: str = "ru", aspect: str = "general") -> DataFrame:
    """REVIEW rows: polarity normalised (lower + strip; others dropped), text
    stripped (null and empty dropped), aspect and language fixed.  Several encodings
    are tried in order for each file."""
    raw = read_csv_raw(spark, path, encoding) if isinstance(encoding, str) else read_csv_decoded(spark, path, encoding)
    t, lab = detect_columns(raw.columns)
    if t is None or lab is None:
        return spark.createDataFrame([], "text string, aspect string, polarity string, lang string")
    pol = L.normalize_polarity(F.col(f"`{lab}`"), strip=True)
    text = py_strip(F.col(f"`{t}`"))
    out = raw.select(text.alias("text"), F.lit(aspect).alias("aspect"), pol.alias("polarity"),
                     F.lit(lang).alias("lang"))
    return out.filter(F.col("polarity").isNotNull() & F.col("text").isNotNull() & (F.length("text") > 0))
