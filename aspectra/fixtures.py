"""Views over the driver's test tables that give the opinion schema.

``reviews``     <- documents: one opinion row per document, with raw aspect
                   terms, raw polarity spellings and phrases that exercise the
                   text and keyword rules (see FIXTURES.md).
``predictions`` <- lineitem: (y_true, y_pred) pairs with model/lang/aspect
                   context, the scale input for metrics and matrices.

The same derivations are inlined as SQL in ``aspectra.plans.oracle``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aspectra.dicts import ASPECTS

# Fixture values (authored for the tests).
RAW_ASPECTS = ["service", " Food ", "price", "delivery", "menu", "Battery Life",
               "general", "ambiance", None, "NULL", "staff", "prix"]
RAW_POLARITIES = ["positive", "pos", "negative", "neg", "neutral", "neu",
                  "conflict", "NEGATIVE"]
PHRASES = ["excellent service", "so good and nice", "worst ever, horrible",
           "annuler la carte", "dommage, l'avis", "décevant",
           "see http://x.io/a?b=1 now", "@bob #fail 42", "жаль, ужасно 5",
           "Café crème", "average product", "", None]
FLAG_TO_POLARITY = [("A", "neg"), ("N", "neutral"), ("R", "pos")]
PRED_LABELS = ["neg", "neutral", "pos"]
PRED_LANGS = ["fr", "en", "ru"]
PRED_MODELS = ["SVM", "xlm-roberta-base", "camembert-base", "DeepPavlov/rubert-base-cased"]
MULTILINGUAL_MODEL = "xlm-roberta-base"


def _pick(values, idx: Column) -> Column:
    """1-based pick from a literal list (nulls allowed)."""
    arr = F.array(*[F.lit(v).cast("string") for v in values])
    return F.element_at(arr, idx.cast("int"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def reviews(spark: SparkSession, sf_dir: str, dealt: bool = True) -> DataFrame:
    """The review view; ``dealt=False`` leaves the rows of a small table in the few tasks
    of its scan, for a caller that shuffles them next anyway."""
    from aspectra.session import spread
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    d = spread(d) if dealt else d
    doc = F.col("doc_id")
    return d.select(
        doc.alias("review_id"),
        F.when(F.col("lang") == "de", F.lit("ru")).otherwise(F.col("lang")).alias("lang"),
        _pick(RAW_ASPECTS, doc % 12 + 1).alias("aspect_raw"),
        _pick(RAW_POLARITIES, F.floor(doc / 12) % 8 + 1).alias("polarity_raw"),
        F.concat(_pick(PHRASES, doc % 13 + 1), F.lit(" "), F.col("text")).alias("text"),
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag")
    # (orderkey, linenumber) is not unique in the test data; rows equal in all
    # of these columns are equal in every derived column, so ties are harmless.
    row_id = F.concat_ws("-", *[F.col(c).cast("string") for c in
                                ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag")])
    from aspectra.dicts import lookup
    y_true = lookup(FLAG_TO_POLARITY, F.col("l_returnflag"))
    y_pred = F.when((F.col("l_partkey") + F.col("l_linenumber")) % 10 < 6, y_true) \
              .otherwise(_pick(PRED_LABELS, F.col("l_linenumber") % 3 + 1))
    return li.select(
        row_id.alias("row_id"),
        _pick(PRED_MODELS, F.col("l_orderkey") % 4 + 1).alias("model"),
        _pick(PRED_LANGS, F.col("l_suppkey") % 3 + 1).alias("lang"),
        _pick(ASPECTS, F.col("l_partkey") % 5 + 1).alias("aspect"),
        y_true.alias("y_true"),
        y_pred.alias("y_pred"),
    )


def eval_lang(model: Column, lang: Column) -> Column:
    """Language under which a model is evaluated: the multilingual model is
    evaluated on the pooled languages ('all')."""
    return F.when(model == MULTILINGUAL_MODEL, F.lit("all")).otherwise(lang)


# Small user-supplied tables used by the text operators' queries.
LEMMAS = [
    ("en", "products", "product"), ("en", "prices", "price"), ("en", "ever", "ever"),
    ("en", "nice", "nice"), ("en", "services", "service"), ("en", "the", "the"),
    ("fr", "avis", "avis"), ("fr", "annuler", "annuler"), ("fr", "plats", "plat"),
    ("es", "los", "el"),
]


def lemma_frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LEMMAS, "lang string, token string, lemma string")


EN_SYNONYMS = [
    ("en", "good", ["fine", "decent"]),
    ("en", "product", ["item", "article", "goods"]),
    ("en", "service", ["help"]),
]
