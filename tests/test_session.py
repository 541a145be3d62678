from pyspark.sql import functions as F

from aspectra.session import broadcast_if_small, spread


def test_spread_only_when_under_parallel(spark):
    one = spark.range(100).coalesce(1)
    assert spread(one).rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism
    many = spark.range(100).repartition(50)
    assert spread(many).rdd.getNumPartitions() == 50


def test_broadcast_if_small_checks_size(spark):
    big = spark.range(1000).withColumn("k", F.col("id") % 3)
    small = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "k long, v string")
    j1 = big.join(broadcast_if_small(small), "k")
    assert "BroadcastHashJoin" in j1._jdf.queryExecution().executedPlan().toString()
    j2 = big.join(broadcast_if_small(small, max_rows=2), "k")
    assert j1.count() == j2.count() == 1000


def test_xml_rows_are_dealt_once(spark, tmpdir_path):
    """Rows that go to files by bucket are shuffled by the writer alone (finding 15)."""
    from aspectra.plans import derived as DV
    spark.createDataFrame([(i, f"text {i}", "en") for i in range(20)], "doc_id long, text string, lang string") \
        .coalesce(1).write.parquet(f"{tmpdir_path}/documents.parquet")
    for frame in (DV.opinion_frame, DV.term_frame):
        df = frame(spark, tmpdir_path)
        assert df.rdd.getNumPartitions() == 1 and df.count() == 20
    csv = DV.labelled_csv_frame(spark, tmpdir_path)
    assert csv.rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism or spark.sparkContext.defaultParallelism <= 2
    assert csv.count() == 20
