from pyspark.sql import functions as F

from aspectra import dicts
from aspectra.functions import labels as L
from aspectra.operators import emotions as E
from aspectra.operators import labeling as LB


def test_normalize_polarity(spark):
    df = spark.createDataFrame([("Positive",), (" neg ",), ("NEU",), ("conflict",), (None,)], "p string")
    xml = [r[0] for r in df.select(L.normalize_polarity("p")).collect()]
    csv = [r[0] for r in df.select(L.normalize_polarity("p", strip=True)).collect()]
    assert xml == ["pos", None, "neutral", None, None]
    assert csv == ["pos", "neg", "neutral", None, None]


def test_normalize_target(spark):
    df = spark.createDataFrame([(None,), ("",), ("NULL",), (" Food ",), ("  ",)], "t string")
    assert [r[0] for r in df.select(L.normalize_target("t")).collect()] == ["general", "general", "general", "Food", ""]


def test_map_aspects_drops_unmapped(spark):
    df = spark.createDataFrame([(" Battery Life ",), ("ambiance",), (None,), ("Rapport qualité/prix",)], "aspect string")
    assert [r.aspect for r in LB.map_aspects(df).collect()] == ["qualité", "prix"]
    small = [r.aspect for r in LB.map_aspects(df.union(spark.createDataFrame([("os",)], "aspect string")),
                                               terms=dicts.ASPECT_TERMS_SMALL).collect()]
    assert small == ["qualité", "prix"]
    assert len(dicts.ASPECT_TERMS) == 54 and len(dicts.ASPECT_TERMS_SMALL) == 41


def test_keyword_emotion_rules(spark):
    rows = [("annuler la carte", "neg"), ("so sad", "neg"), ("meh", "neg"), ("AMAZING", "pos"),
            ("fine", "pos"), ("average stuff", "neutral"), ("average stuff", None), ("ok", "other"),
            (None, "neg")]
    df = spark.createDataFrame(rows, "text string, polarity string")
    got = [r.emotion for r in E.keyword_emotion(df).collect()]
    assert got == ["colère", "tristesse", "insatisfaction", "joie", "satisfaction",
                   "insatisfaction", "insatisfaction", "satisfaction", "insatisfaction"]


def test_silver_fallback_uses_whole_texts(spark):
    long = "x" * 600 + " horrible"
    df = spark.createDataFrame([(long, "neg"), ("   ", None), ("joy", None)], "text string, polarity string")
    got = [r.emotion for r in E.label_emotions_silver(df).collect()]
    assert got == ["colère", "satisfaction", "satisfaction"]


def test_silver_with_scorer_and_failures(spark):
    df = spark.createDataFrame([(i, "horrible" if i % 2 else "nice", "neg") for i in range(70)],
                               "i int, text string, polarity string").repartition(3)

    def factory():
        def score(texts):
            if any("boom" in t for t in texts):
                raise RuntimeError("batch failed")
            return ["anger" if "horrible" in t else "weird" for t in texts]
        return score

    got = {r.i: r.emotion for r in E.label_emotions_silver(df, factory, batch_size=8).collect()}
    assert got[1] == "colère"            # mapped model label
    assert got[0] == "insatisfaction"    # unknown label -> keyword rule


def test_encode_and_gates(spark):
    df = spark.createDataFrame([("fr", "prix", "pos"), ("fr", "prix", "neg"), ("en", "prix", "pos")],
                               "lang string, aspect string, polarity string")
    codes = [r.label for r in LB.encode_polarity(df).collect()]
    assert codes == [2, 0, 2]
    g = {(r.lang): r.status for r in LB.data_gates(df).collect()}
    assert g == {"fr": "ok", "en": "single_class"}
