"""Dictionary tables of the domain.

All lists and maps under "FIXED VALUES" must equal the values the original
pipeline uses, because results (mapped aspects, emotions, stopword removal,
synonyms, quotas, display names) depend on them.  They are stated plainly, in
their natural order.  Everything else in this module only turns them into
Spark objects: map literals (tiny, bounded, evaluated inside whole-stage
codegen without any join) or small DataFrames for callers that prefer joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ===========================================================================
# FIXED VALUES
# ===========================================================================

LANGUAGES = ["fr", "en", "ru"]

# Five aspect categories, in display order.
ASPECTS = ["qualité", "service", "prix", "livraison", "interface"]

# Raw aspect term (lower-cased, stripped) -> category.  Main dictionary (54 terms).
ASPECT_TERMS = [
    ("quality", "qualité"), ("food", "qualité"), ("meal", "qualité"),
    ("taste", "qualité"), ("plats", "qualité"), ("cuisine", "qualité"),
    ("repas", "qualité"), ("produits", "qualité"), ("nourriture", "qualité"),
    ("battery life", "qualité"), ("battery", "qualité"), ("screen", "qualité"),
    ("display", "qualité"), ("build quality", "qualité"), ("hardware", "qualité"),
    ("performance", "qualité"), ("product", "qualité"), ("camera", "qualité"),
    ("sound", "qualité"),
    ("service", "service"), ("staff", "service"), ("waiter", "service"),
    ("waitress", "service"), ("accueil", "service"), ("personnel", "service"),
    ("support", "service"), ("customer service", "service"),
    ("management", "service"), ("server", "service"),
    ("price", "prix"), ("cost", "prix"), ("value", "prix"), ("prix", "prix"),
    ("tarif", "prix"), ("rapport qualité/prix", "prix"),
    ("rapport qualité-prix", "prix"), ("prices", "prix"),
    ("delivery", "livraison"), ("shipping", "livraison"),
    ("livraison", "livraison"), ("delai", "livraison"),
    ("packaging", "livraison"), ("emballage", "livraison"),
    ("interface", "interface"), ("software", "interface"), ("app", "interface"),
    ("features", "interface"), ("usability", "interface"), ("design", "interface"),
    ("menu", "interface"), ("carte", "interface"), ("os", "interface"),
    ("keyboard", "interface"), ("touchpad", "interface"),
]

# Smaller variant of the same dictionary (41 terms).
ASPECT_TERMS_SMALL = [
    ("quality", "qualité"), ("food", "qualité"), ("meal", "qualité"),
    ("taste", "qualité"), ("plats", "qualité"), ("cuisine", "qualité"),
    ("repas", "qualité"), ("produits", "qualité"), ("battery life", "qualité"),
    ("battery", "qualité"), ("screen", "qualité"), ("build quality", "qualité"),
    ("hardware", "qualité"), ("performance", "qualité"),
    ("service", "service"), ("staff", "service"), ("waiter", "service"),
    ("waitress", "service"), ("accueil", "service"), ("personnel", "service"),
    ("support", "service"), ("customer service", "service"),
    ("price", "prix"), ("cost", "prix"), ("value", "prix"), ("prix", "prix"),
    ("rapport qualité/prix", "prix"), ("tarif", "prix"),
    ("delivery", "livraison"), ("shipping", "livraison"),
    ("livraison", "livraison"), ("delai", "livraison"), ("packaging", "livraison"),
    ("interface", "interface"), ("software", "interface"), ("app", "interface"),
    ("features", "interface"), ("usability", "interface"), ("design", "interface"),
    ("menu", "interface"), ("carte", "interface"),
]

# Raw polarity spelling (lower-cased) -> polarity code.
POLARITY_SPELLINGS = [
    ("positive", "pos"), ("pos", "pos"),
    ("negative", "neg"), ("neg", "neg"),
    ("neutral", "neutral"), ("neu", "neutral"),
]

POLARITIES = ["neg", "neutral", "pos"]

# Two integer codings of polarity exist; the first is the default.
POLARITY_CODES = {"neg": 0, "neutral": 1, "pos": 2}
POLARITY_CODES_ALT = {"pos": 0, "neutral": 1, "neg": 2}

# Five emotions and their integer codes.
EMOTIONS = ["joie", "satisfaction", "insatisfaction", "colère", "tristesse"]
EMOTION_CODES = {"joie": 0, "satisfaction": 1, "insatisfaction": 2,
                 "colère": 3, "tristesse": 4}

# Emotion keywords, long list (used by the deterministic keyword rule).
EMOTION_KEYWORDS = {
    "joie": ["excellent", "parfait", "génial", "super", "fantastique", "adoré",
             "wonderful", "amazing", "love", "perfect", "great", "best",
             "отлично", "прекрасно", "замечательно"],
    "satisfaction": ["bien", "bon", "correct", "satisfait", "bonne", "good", "nice",
                     "ok", "хорошо", "нормально", "доволен"],
    "insatisfaction": ["décevant", "insuffisant", "moyen", "mediocre", "disappointing",
                       "average", "разочарован", "посредственно"],
    "colère": ["horrible", "nul", "scandaleux", "inacceptable", "terrible",
               "awful", "worst", "hate", "disgusting", "ужасно", "отвратительно"],
    "tristesse": ["déçu", "dommage", "regret", "unfortunate", "sad", "disappointed",
                  "unfortunately", "жаль", "разочарование"],
}

# Emotion keywords, short list (used as fallback of the silver labeller).
EMOTION_KEYWORDS_SHORT = {
    "joie": ["excellent", "parfait", "génial", "wonderful", "amazing", "отлично"],
    "satisfaction": ["bien", "bon", "correct", "good", "nice", "хорошо"],
    "insatisfaction": ["décevant", "insuffisant", "disappointing", "разочарован"],
    "colère": ["horrible", "nul", "terrible", "awful", "worst", "ужасно"],
    "tristesse": ["déçu", "dommage", "sad", "disappointed", "жаль"],
}

# Raw labels of an emotion scoring model -> emotion.
MODEL_LABELS = [
    ("joy", "joie"), ("love", "joie"), ("optimism", "satisfaction"),
    ("neutral", "satisfaction"), ("surprise", "satisfaction"),
    ("anger", "colère"), ("disgust", "insatisfaction"),
    ("fear", "insatisfaction"), ("sadness", "tristesse"),
]

# Fallback stopword lists per language.
STOPWORDS = {
    "fr": ["le", "la", "les", "un", "une", "des", "de", "du", "au", "aux",
           "et", "ou", "mais", "donc", "car", "ni", "or", "pour", "par",
           "avec", "sans", "chez", "dans", "sur", "sous", "entre", "parmi",
           "je", "tu", "il", "elle", "on", "nous", "vous", "ils", "elles",
           "me", "te", "se", "le", "la", "lui", "leur", "y", "en",
           "ce", "cet", "cette", "ces", "mon", "ton", "son", "notre",
           "votre", "leur", "ma", "ta", "sa", "mes", "tes", "ses",
           "nos", "vos", "leurs", "quel", "quels", "quelle", "quelles"],
    "en": ["i", "me", "my", "you", "your", "he", "him", "his", "she", "her",
           "it", "we", "us", "our", "they", "them", "their", "a", "an",
           "the", "of", "and", "to", "in", "is", "for", "on", "at", "by",
           "with", "as", "was", "were", "are", "been", "being", "have",
           "has", "had", "do", "does", "did", "will", "would", "could",
           "should", "may", "might", "must", "shall", "from", "up", "down"],
    "ru": ["и", "в", "во", "не", "что", "он", "на", "я", "с", "со",
           "как", "а", "то", "все", "она", "так", "его", "но", "да",
           "ты", "к", "у", "же", "вы", "за", "бы", "по", "только",
           "ее", "мне", "было", "вот", "от", "меня", "еще", "нет",
           "о", "из", "ним", "теперь", "когда", "даже", "ну", "вдруг"],
}

# Built-in synonym lists (French and Russian); other languages are supplied by
# the caller as a (lang, word, alternatives) table.
SYNONYMS = [
    ("fr", "bon", ["excellent", "super", "correct"]),
    ("fr", "bonne", ["excellent", "super", "correct"]),
    ("fr", "mauvais", ["médiocre", "déplorable"]),
    ("fr", "mauvaise", ["médiocre", "déplorable"]),
    ("ru", "хороший", ["отличный", "прекрасный"]),
    ("ru", "хорошо", ["отличный", "прекрасный"]),
    ("ru", "плохой", ["ужасный", "скверный"]),
    ("ru", "плохо", ["ужасный", "скверный"]),
]
SYNONYM_PROB = 0.3

# Balanced corpus quota per language.
POLARITY_QUOTA = [("pos", 0.40), ("neg", 0.40), ("neutral", 0.20)]
TARGET_PER_LANG = 800
SAMPLE_PER_LANG = 800

# Display names of models and languages in the comparison matrices.
MODEL_SHORT = [
    ("xlm-roberta-base", "XLM-R"),
    ("camembert-base", "CamemBERT"),
    ("DeepPavlov/rubert-base-cased", "RuBERT"),
    ("SVM_TF-IDF", "SVM"),
    ("SVM", "SVM"),
]
LANG_LABEL = [("fr", "FR"), ("en", "EN"), ("ru", "RU"), ("all", "ALL")]
# Column order of the aspect matrix: per language, these models first.
MATRIX_MODEL_ORDER = ["SVM", "XLM-R", "CamemBERT", "RuBERT"]
BASELINE_MODEL = "SVM"

# Candidate column names of labelled CSV files (case-insensitive, last wins).
CSV_TEXT_COLUMNS = ["text", "sentence", "review", "content", "post", "body", "tweet"]
CSV_LABEL_COLUMNS = ["label", "polarity", "sentiment", "class", "category", "tag"]

# Splits, folds and seed.
SEED = 42
CV_FOLDS = 5
TEST_SPLIT = 0.15
VAL_SPLIT = 0.15

# TF-IDF and classifier parameters.
TFIDF_MIN_DF = 2
TFIDF_MAX_FEATURES = 50000
SVM_C = 1.0
MIN_ROWS_EMOTION = 30
MIN_ROWS_RU_WARNING = 100

# ===========================================================================
# Spark views of the fixed values
# ===========================================================================


def map_literal(pairs) -> Column:
    """A ``map<string,string>`` literal built from (key, value) pairs."""
    args = []
    for k, v in pairs:
        args += [F.lit(k), F.lit(v)]
    return F.create_map(*args)


def array_literal(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def lookup(pairs, key: Column) -> Column:
    """Dictionary lookup as a projection: null when the key is absent."""
    return F.element_at(map_literal(pairs), key)


def dict_frame(spark: SparkSession, pairs, names=("term", "category")) -> DataFrame:
    return spark.createDataFrame(list(pairs), list(names))


def stopword_frame(spark: SparkSession) -> DataFrame:
    rows = [(lang, w) for lang, ws in STOPWORDS.items() for w in dict.fromkeys(ws)]
    return spark.createDataFrame(rows, "lang string, word string")


def synonym_frame(spark: SparkSession, extra=None) -> DataFrame:
    rows = list(SYNONYMS) + list(extra or [])
    return spark.createDataFrame(rows, "lang string, word string, alternatives array<string>")


def quota_frame(spark: SparkSession, target: int = TARGET_PER_LANG) -> DataFrame:
    rows = [(p, r, int(target * r)) for p, r in POLARITY_QUOTA]
    return spark.createDataFrame(rows, "polarity string, ratio double, quota int")
