"""All raw files below a folder as one review table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from aspectra.sources import csv as SCSV
from aspectra.sources import xml as SX


def route_inputs(spark: SparkSession, path: str, encoding: str | tuple = SCSV.ENCODINGS) -> DataFrame:
    """(text, aspect, polarity, lang) of all files: XML by layout and language of the
    single file, labelled CSV in the first encoding that fits the file, always Russian;
    other formats are left out."""
    rows = SX.route_xml(spark, path).select(*SX.REVIEW_COLS)
    if SCSV.has_csv(spark, path):
        rows = rows.unionByName(SCSV.read_labelled_csv(spark, path, encoding).select(*SX.REVIEW_COLS))
    return rows
