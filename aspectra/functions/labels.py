"""Label normalisation and rule labelling as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from aspectra import dicts
from aspectra.functions.text import py_strip


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normalize_polarity(raw, strip: bool = False) -> Column:
    """positive/pos -> pos, negative/neg -> neg, neutral/neu -> neutral, else
    null (callers drop null rows).  XML input is only lower-cased; CSV input is
    also stripped."""
    v = F.lower(_c(raw))
    if strip:
        v = py_strip(v)
    return dicts.lookup(dicts.POLARITY_SPELLINGS, v)


def normalize_target(raw) -> Column:
    """Missing, empty or the string "NULL" -> 'general'; otherwise stripped."""
    t = _c(raw)
    return F.when(t.isNull() | (t == "") | (t == "NULL"), F.lit("general")) \
            .otherwise(py_strip(t))


def map_aspect(raw, terms=dicts.ASPECT_TERMS) -> Column:
    """Raw aspect term -> category (null when unknown or null)."""
    return dicts.lookup(terms, F.lower(py_strip(_c(raw))))


def encode_polarity(polarity, codes: dict[str, int] = dicts.POLARITY_CODES) -> Column:
    return F.element_at(F.create_map(*[x for k, v in codes.items()
                                       for x in (F.lit(k), F.lit(v))]), _c(polarity))


def encode_emotion(emotion) -> Column:
    return F.element_at(F.create_map(*[x for k, v in dicts.EMOTION_CODES.items()
                                       for x in (F.lit(k), F.lit(v))]), _c(emotion))


def _has_any(text_lower: Column, words) -> Column:
    cond = F.lit(False)
    for w in words:
        cond = cond | F.coalesce(text_lower.contains(w), F.lit(False))
    return cond


def keyword_emotion(text, polarity, keywords=dicts.EMOTION_KEYWORDS) -> Column:
    """Deterministic emotion from polarity and keyword *substrings* of the
    lower-cased text:  pos -> joie if a joie keyword occurs, else satisfaction;
    neg -> colère, else tristesse, else insatisfaction; anything else (incl.
    null) -> insatisfaction if such a keyword occurs, else satisfaction."""
    t = F.lower(_c(text))
    p = _c(polarity)
    return (
        F.when(p == "pos",
               F.when(_has_any(t, keywords["joie"]), "joie").otherwise("satisfaction"))
        .when(p == "neg",
              F.when(_has_any(t, keywords["colère"]), "colère")
              .when(_has_any(t, keywords["tristesse"]), "tristesse")
              .otherwise("insatisfaction"))
        .otherwise(F.when(_has_any(t, keywords["insatisfaction"]), "insatisfaction")
                   .otherwise("satisfaction"))
    )


def silver_text(text, max_chars: int | None = None) -> Column:
    """Text as given to the scorer, blank -> '.'; a scorer with a limited input
    sets ``max_chars``."""
    t = F.coalesce(_c(text), F.lit(""))
    return F.when(py_strip(t) == "", F.lit(".")).otherwise(t if max_chars is None else F.substring(t, 1, max_chars))


def keyword_emotion_short(text, polarity) -> Column:
    """Silver-labeller fallback: short keyword list on the scorer's text,
    missing polarity counts as neutral."""
    return keyword_emotion(silver_text(text), F.coalesce(_c(polarity), F.lit("neutral")),
                           dicts.EMOTION_KEYWORDS_SHORT)


def map_model_label(raw_label, text, polarity) -> Column:
    """Scorer label (lower-cased) -> emotion; unknown/missing -> keyword rule."""
    mapped = dicts.lookup(dicts.MODEL_LABELS, F.lower(_c(raw_label)))
    return F.coalesce(mapped, keyword_emotion_short(text, polarity))
