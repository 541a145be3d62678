"""Structured Streaming: the stateless Column operators run unchanged on a
streaming DataFrame (the original has no stream processing, so no state,
watermark or window is needed)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from aspectra.functions import text as T
from aspectra.operators import emotions as E


def label_stream(stream: DataFrame, text: str = "text", lang: str = "lang",
                 polarity: str = "polarity") -> DataFrame:
    """Normalised text and keyword emotion for every arriving review."""
    d = stream.withColumn("text_processed", T.normalize_text(text, lang))
    return E.keyword_emotion(d, text=text, polarity=polarity)


def start_label_stream(spark: SparkSession, source_path: str, schema, sink_path: str,
                       checkpoint: str, trigger_once: bool = True):
    """Parquet folder in -> labelled parquet out, exactly-once through the
    streaming checkpoint (which must live on shared storage)."""
    s = spark.readStream.schema(schema).parquet(source_path)
    w = (label_stream(s).writeStream.format("parquet").option("path", sink_path)
         .option("checkpointLocation", checkpoint).outputMode("append"))
    w = w.trigger(availableNow=True) if trigger_once else w.trigger(processingTime="30 seconds")
    return w.start()
