"""Files that Spark derives from the driver tables, so the readers have real
input whose size grows with the tables: review XML in both layouts, a
labelled CSV, published corpus tables and nested result records.

Everything is written under the shared checkpoint folder of the session.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aspectra import fixtures as fx
from aspectra.session import scratch_path, spread


def opinion_frame(spark: SparkSession, sf: str) -> DataFrame:
    """One sentence per document with two opinions, the second one nested deeper for
    every other document; bucket 4 holds only 'conflict' opinions (its files need the
    whole-text fallback)."""
    r = fx.reviews(spark, sf, dealt=False)           # dealt over the files by write_xml
    doc = F.col("review_id")
    bucket = (doc % 5).cast("int")
    p1 = F.when(bucket == 4, F.lit("conflict")).otherwise(F.col("polarity_raw"))
    p2 = F.when(bucket == 4, F.lit("conflict")).otherwise(
        fx._pick(fx.RAW_POLARITIES, (F.floor(doc / 12) + 3) % 8 + 1))
    o1 = F.struct(F.col("aspect_raw").alias("_target"), F.lit(None).cast("string").alias("_category"),
                  p1.alias("_polarity"))
    o2 = F.struct(fx._pick(fx.RAW_ASPECTS, (doc + 5) % 12 + 1).alias("_target"),
                  F.lit(None).cast("string").alias("_category"), p2.alias("_polarity"))
    deep = doc % 2 == 1
    group = F.when(deep, F.struct(F.struct(F.array(o2).alias("Opinion")).alias("Part")))
    flat = F.when(deep, F.array(o1)).otherwise(F.array(o1, o2))
    return r.select(bucket.alias("bucket"), _file_no(doc), doc.cast("string").alias("_id"), "text",
                    F.struct(flat.alias("Opinion"), group.alias("Group")).alias("Opinions"))


def _file_no(doc) -> F.Column:
    """Spreads the rows of a bucket or source over files of some hundred documents."""
    return (F.floor(doc / 200) % 32).cast("int").alias("_file_no")


def term_frame(spark: SparkSession, sf: str) -> DataFrame:
    """One sentence per document in the term layout; the source folder name
    carries the language; 'en_conflicts' files hold no valid term; every 7th
    sentence has no aspectTerms block."""
    r = fx.reviews(spark, sf, dealt=False)           # dealt over the files by write_xml
    doc = F.col("review_id")
    src = F.element_at(F.array(F.lit("fr_reviews"), F.lit("en_laptops"), F.lit("en_conflicts")),
                       (doc % 3 + 1).cast("int"))
    pol = F.when(src == "en_conflicts", F.lit("conflict")).otherwise(F.col("polarity_raw"))
    t = F.struct(F.col("aspect_raw").alias("_term"), pol.alias("_polarity"))
    terms = F.when(doc % 7 == 0, F.lit(None)).otherwise(F.struct(F.array(t).alias("aspectTerm")))
    return r.select(src.alias("src"), _file_no(doc), doc.cast("string").alias("_id"), "text", terms.alias("aspectTerms"))


def write_xml(df: DataFrame, path: str, part_col: str, root_tag: str, row_tag: str = "sentence") -> str:
    """A folder per value of ``part_col``, its rows dealt over files."""
    (df.repartition(part_col, "_file_no").drop("_file_no").write.mode("overwrite").partitionBy(part_col).format("xml")
       .option("rootTag", root_tag).option("rowTag", row_tag).save(path))
    return path


def opinion_xml(spark: SparkSession, sf: str, path: str | None = None) -> str:
    path = path or scratch_path(spark, "opinion-xml")
    return write_xml(opinion_frame(spark, sf), path, "bucket", "Reviews")


def term_xml(spark: SparkSession, sf: str, path: str | None = None) -> str:
    """The term layout; some files of the laptops are in the older one without sentences."""
    path = path or scratch_path(spark, "term-xml")
    rows = term_frame(spark, sf)
    old = (F.col("src") == "en_laptops") & (F.col("_file_no") % 4 == 3)
    write_xml(rows.where(~old), f"{path}/new", "src", "sentences")
    write_xml(rows.where(old), f"{path}/old", "src", "reviews", "review")
    return path


CSV_LABELS = ["positive", " pos ", "negative", "NEG", "neutral", "neu", "other", "Positive"]


def labelled_csv_frame(spark: SparkSession, sf: str) -> DataFrame:
    """Columns post, id, Text, sentiment, Label: two text candidates and two
    label candidates, the last of each wins."""
    r = spread(fx.reviews(spark, sf, dealt=False), enough=0.5)
    doc = F.col("review_id")
    return r.select(F.lit("ignored").alias("post"), doc.alias("id"), F.col("text").alias("Text"),
                    F.lit("x").alias("sentiment"),
                    fx._pick(CSV_LABELS, doc % len(CSV_LABELS) + 1).alias("Label"))


def labelled_csv(spark: SparkSession, sf: str, path: str | None = None) -> str:
    path = path or scratch_path(spark, "labelled-csv")
    (labelled_csv_frame(spark, sf).write.mode("overwrite").option("header", True)
     .option("escape", '"').option("ignoreLeadingWhiteSpace", False)
     .option("ignoreTrailingWhiteSpace", False).csv(path))
    return path


#: charset of the writer for each encoding; the text goes out byte for byte
CSV_ENCODINGS = ["utf-8", "windows-1251", "iso-8859-1"]


def mixed_csv(spark: SparkSession, sf: str, path: str | None = None) -> str:
    """The labelled CSV as files in three encodings, by document.  Texts are cut to what
    their encoding can hold; every file holds a letter that tells it from the others."""
    from aspectra.sources.csv import _UPPER_1251, _UPPER_LATIN
    path = path or scratch_path(spark, "mixed-csv")
    rows = mixed_csv_frame(spark, sf)
    for i, encoding in enumerate(CSV_ENCODINGS):
        part = rows.where(F.col("id") % 3 == i)
        if encoding == "windows-1251":
            # written as the characters whose ISO-8859-1 bytes are those of windows-1251
            part = part.withColumn("Text", F.translate("Text", _UPPER_1251, _UPPER_LATIN))
        (part.write.mode("append").option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False)
         .option("ignoreTrailingWhiteSpace", False).option("encoding", "UTF-8" if i == 0 else "ISO-8859-1").csv(path))
    return path


MIXED_MARKS = ["Это é", "жук", "déjà \u0098"]


def mixed_csv_frame(spark: SparkSession, sf: str) -> DataFrame:
    """The labelled CSV with ASCII texts, each led by letters of its file's encoding."""
    mark = fx._pick(MIXED_MARKS, F.col("id") % 3 + 1)
    bare = F.regexp_replace("Text", r"[^\x00-\x7F]", "")
    return labelled_csv_frame(spark, sf).withColumn("Text", F.concat(mark, F.lit(" "), bare))
