from pyspark.sql import functions as F

from aspectra.operators import augment as AU


def frame(spark, n_neutral=5, n_other=40):
    rows = [(i, "fr", "neutral", "il est bon et mauvais", "x") for i in range(n_neutral)]
    rows += [(100 + i, "en", "pos", "good", "y") for i in range(n_other)]
    return spark.createDataFrame(rows, "review_id long, lang string, polarity string, text_processed string, text string")


def test_augmentation_reaches_half_of_others(spark):
    df = frame(spark)
    g = AU.augment_class(df)
    assert g.count() == 40 // 2 - 5
    u = AU.balanced_union(df, g)
    assert u.filter(F.col("polarity") == "neutral").count() == 20
    # generated rows copy the drawn row and use synonyms only from the table
    for r in g.collect():
        assert r.text == r.text_processed and r.lang == "fr"
        assert set(r.text.split()) <= {"il", "est", "et", "bon", "mauvais", "excellent", "super",
                                       "correct", "médiocre", "déplorable"}


def test_empty_target_or_balanced_gives_nothing(spark):
    assert AU.augment_class(frame(spark, n_neutral=0)).count() == 0
    assert AU.augment_class(frame(spark, n_neutral=30)).count() == 0


def test_replace_synonyms_deterministic(spark):
    df = spark.createDataFrame([(1, "fr", "bon " * 50)], "id long, lang string, t string")
    a = df.select(AU.replace_synonyms("t", "lang", "id").alias("o")).first().o
    b = df.repartition(3).select(AU.replace_synonyms("t", "lang", "id").alias("o")).first().o
    assert a == b and a != ("bon " * 50).strip()
    changed = sum(1 for w in a.split() if w != "bon")
    assert 5 <= changed <= 30
