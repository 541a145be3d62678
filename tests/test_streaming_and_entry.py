from pyspark.sql import functions as F

from aspectra.functions import text as T
from aspectra.operators import emotions as E

from conftest import SF001


def test_streaming_parity(spark, tmpdir_path):
    import __spark_entry__  # noqa: F401
    from aspectra import fixtures as fx
    src = fx.reviews(spark, SF001).select("review_id", "lang", "text",
                                          F.lit("neg").alias("polarity"))
    path = f"{tmpdir_path}/in"
    src.write.parquet(path)
    batch = src.select("review_id", T.normalize_text("text", "lang").alias("t")) \
               .join(E.keyword_emotion(src).select("review_id", "emotion"), "review_id")
    stream = spark.readStream.schema(src.schema).parquet(path)
    out = stream.select("review_id", T.normalize_text("text", "lang").alias("t"),
                        F.col("text"), F.col("polarity"))
    out = E.keyword_emotion(out).select("review_id", "t", "emotion")
    q = out.writeStream.format("memory").queryName("parity").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted(tuple(r) for r in spark.sql("SELECT review_id, t, emotion FROM parity").collect())
    exp = sorted(tuple(r) for r in batch.select("review_id", "t", "emotion").collect())
    assert got == exp and len(got) > 0


def test_entry_and_registry(spark):
    import __spark_entry__ as E2
    df = E2.entry(spark)
    assert df.count() > 0
    assert set(df.columns) >= {"aspect", "polarity", "joie", "colère"}
    qs, sqls = E2.queries(), E2.oracle_sql()
    assert set(sqls) <= set(qs)
    assert len(qs) >= 80 and len(sqls) >= 75


def test_label_stream_module(spark, tmpdir_path):
    from aspectra.streaming.labeling import start_label_stream
    src = spark.createDataFrame([(1, "fr", "Dommage, horrible !", "neg"), (2, "en", "Great", "pos")],
                                "review_id long, lang string, text string, polarity string")
    src.write.parquet(f"{tmpdir_path}/in")
    q = start_label_stream(spark, f"{tmpdir_path}/in", src.schema, f"{tmpdir_path}/out", f"{tmpdir_path}/ck")
    q.awaitTermination(120)
    out = {r.review_id: (r.text_processed, r.emotion) for r in spark.read.parquet(f"{tmpdir_path}/out").collect()}
    assert out == {1: ("dommage horrible", "colère"), 2: ("great", "joie")}
