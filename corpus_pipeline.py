"""Cleaning of a corpus: quality rules, near duplicates, repeated passages,
benchmark passages, and the mixture of sources.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame, which the driver of a run writes as Parquet and reads again
as the next one's ``docs``.  All but the last keep the columns of documents.
``run`` applies them to the documents of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aspectra.llm.decontamination import decontaminate
from aspectra.llm.minhash_forest import near_duplicates
from aspectra.llm.mixing import mix
from aspectra.llm.quality import keep_quality
from aspectra.llm.suffix_dedup import without_repeats
from aspectra.session import scratch_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return keep_quality(docs)


NEAR_PERCENT = 80            # similarity of 5-word sets from which documents are near duplicates


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id; rows equal
    in all columns to one before them go as well, rows that share only the id stay.
    Null, empty and wordless texts are linked with nothing; an empty table gives none."""
    kept = near_duplicates(docs, percent=NEAR_PERCENT).where("kept").select(F.col("doc_id").alias("_id")).distinct()
    rows = docs.select(F.struct("*").alias("_row"))
    with_id = rows.where("_row.doc_id is not null").join(kept, F.col("_row.doc_id") == F.col("_id"), "left_semi").distinct()
    return with_id.union(rows.where("_row.doc_id is null")).select("_row.*")


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 bytes and more that an earlier one has."""
    return without_repeats(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture of sources, shuffled, with copy numbers and order keys."""
    return mix(docs)


STAGES = [
    ("quality", quality_rules),
    ("near_dedup", near_dedup),
    ("passage_dedup", passage_dedup),
    ("decontamination", benchmark_decontamination),
    ("mixing", source_mixture),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL can't express near duplicates by signatures on whole tables in useful time; tests
#: compare run() with a brute-force version.
ORACLE_SQL = None
