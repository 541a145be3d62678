"""Text normalisation as Column expressions (JVM-side, whole-stage codegen).

Python's ``\\w``, ``\\s`` and ``\\d`` on ``str`` are Unicode-aware while Java's
are ASCII by default, so explicit character classes are used everywhere.
The same patterns run unchanged in Java regex (Spark) and RE2 (DuckDB).
"""

from __future__ import annotations

import re
import sys
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Character classes equal to Python's Unicode \w, \s, \S, \d.
SPACE_CHARS = r"\t-\r\x1c-\x20\x{85}\p{Z}"
WORD_CHARS = r"\p{L}\p{N}_"
SPACE = f"[{SPACE_CHARS}]"
NON_SPACE = f"[^{SPACE_CHARS}]"
WORD = f"[{WORD_CHARS}]"
DIGIT = r"\p{Nd}"

URL_PATTERN = rf"https?://{NON_SPACE}+|www\.{NON_SPACE}+"
MENTION_PATTERN = rf"@{WORD}+"
HASHTAG_PATTERN = rf"#{WORD}+"
PUNCT_PATTERN = f"[^{WORD_CHARS}{SPACE_CHARS}]"
PUNCT_PATTERN_FR = f"[^{WORD_CHARS}{SPACE_CHARS}']"
DIGITS_PATTERN = f"{DIGIT}+"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def py_strip(text) -> Column:
    """Python ``str.strip()``: removes all Unicode whitespace at both ends."""
    return F.regexp_replace(_c(text), f"^{SPACE}+|{SPACE}+$", "")


def remove_urls(text) -> Column:
    return F.regexp_replace(_c(text), URL_PATTERN, "")


def remove_mentions_hashtags(text) -> Column:
    return F.regexp_replace(F.regexp_replace(_c(text), MENTION_PATTERN, ""),
                            HASHTAG_PATTERN, "")


def remove_punctuation(text, lang) -> Column:
    """Delete characters that are neither word nor space; French keeps the
    ASCII apostrophe (the typographic one is deleted)."""
    t = _c(text)
    return F.when(_c(lang) == "fr", F.regexp_replace(t, PUNCT_PATTERN_FR, "")) \
            .otherwise(F.regexp_replace(t, PUNCT_PATTERN, ""))


def remove_digits(text, lang) -> Column:
    """Delete digit runs except for Russian (a null language counts as non-Russian)."""
    t = _c(text)
    return F.when(F.coalesce(_c(lang), F.lit("")) == "ru", t) \
            .otherwise(F.regexp_replace(t, DIGITS_PATTERN, ""))


def collapse_whitespace(text) -> Column:
    """Whitespace runs -> one space, then strip (after collapsing, only ASCII
    spaces remain, so ``trim`` is exact)."""
    return F.trim(F.regexp_replace(_c(text), f"{SPACE}+", " "))


# --- NFKD accent stripping: the one Python step (no JVM built-in exists) ---

def _combining_class_pattern() -> re.Pattern:
    # Built by rule: every code point with a non-zero canonical combining
    # class.  All of them lie in planes 0-1 of the Unicode database.
    chars = [chr(i) for i in range(min(sys.maxunicode + 1, 0x20000)) if unicodedata.combining(chr(i))]
    return re.compile("[" + "".join(re.escape(c) for c in chars) + "]")


_COMBINING = None


def _strip_accents_series(s: pd.Series) -> pd.Series:
    global _COMBINING
    if _COMBINING is None:
        _COMBINING = _combining_class_pattern()
    return s.str.normalize("NFKD").str.replace(_COMBINING, "", regex=True)


@F.pandas_udf(StringType())
def _strip_accents_udf(s: pd.Series) -> pd.Series:
    return _strip_accents_series(s)


# Only text containing a character outside ASCII can change under NFKD.
_NON_ASCII = r"[^\x00-\x7f]"


def _combining_regex_class() -> str:
    """Java regex class of every code point with a non-zero canonical
    combining class (built by rule from the Unicode database), as ranges.  Java tries
    the ranges one after the other, so the intersection turns away every character
    that is no mark (or unknown to Java's Unicode) before any of them."""
    cps = [i for i in range(min(sys.maxunicode + 1, 0x20000)) if unicodedata.combining(chr(i))]
    ranges, start, prev = [], cps[0], cps[0]
    for c in cps[1:]:
        if c != prev + 1:
            ranges.append((start, prev))
            start = c
        prev = c
    ranges.append((start, prev))
    members = "".join(f"\\x{{{a:X}}}" if a == b else f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges)
    return f"[\\x{{{cps[0]:X}}}-\\x{{{cps[-1]:X}}}&&[\\p{{M}}\\p{{Cn}}]&&[{members}]]"


COMBINING_CLASS = _combining_regex_class()
_ICU = "com.ibm.icu.text.Normalizer"
_ICU_OK: bool | None = None


def _icu_available() -> bool:
    """ICU4J ships with Spark 4 (collations); probe it once on the driver."""
    global _ICU_OK
    if _ICU_OK is None:
        try:
            from pyspark.sql import SparkSession
            jvm = SparkSession.getActiveSession()._jvm
            jvm.java.lang.Class.forName(_ICU)
            _ICU_OK = True
        except Exception:  # noqa: BLE001
            _ICU_OK = False
    return _ICU_OK


def strip_accents(text) -> Column:
    """NFKD, then drop combining marks.  JVM-side: ICU's NFKD through
    ``reflect`` and one regex over the combining-mark class; pure-ASCII rows
    are passed through untouched.  Without ICU on the classpath an
    Arrow-batched pandas UDF does the same."""
    t = _c(text)
    needs = t.rlike(_NON_ASCII)
    if _icu_available():
        nfkd = F.call_function("reflect", F.lit(_ICU), F.lit("decompose"), t, F.lit(True))
        return F.when(needs, F.regexp_replace(nfkd, COMBINING_CLASS, "")).otherwise(t)
    return F.when(needs, _strip_accents_udf(F.when(needs, t))).otherwise(t)


def normalize_text(text, lang) -> Column:
    """lower -> (EN) strip accents -> URLs -> mentions/hashtags -> punctuation
    -> digits (not RU) -> collapse whitespace.  Null text -> ''."""
    lang = _c(lang)
    t = F.lower(F.coalesce(_c(text), F.lit("")))
    en = F.coalesce(lang == "en", F.lit(False))
    t = F.when(en, strip_accents(F.when(en, t))).otherwise(t)
    t = remove_urls(t)
    t = remove_mentions_hashtags(t)
    t = remove_punctuation(t, lang)
    t = remove_digits(t, lang)
    return collapse_whitespace(t)


def tokens(text) -> Column:
    """Whitespace tokens of normalised text ('' -> [])."""
    t = _c(text)
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, " "))


def remove_stopwords(text, lang, stopwords: dict[str, list[str]],
                     custom: list[str] | None = None) -> Column:
    """Drop tokens found in the language's stopword set (unioned with
    ``custom``); unknown language -> only ``custom``.  Text must already be
    normalised (single spaces)."""
    from aspectra.dicts import array_literal
    args = []
    for lg, words in stopwords.items():
        args += [F.lit(lg), array_literal(sorted(set(words) | set(custom or [])))]
    stop = F.coalesce(F.element_at(F.create_map(*args), _c(lang)),
                      array_literal(sorted(set(custom or []))).cast("array<string>"))
    kept = F.filter(tokens(text), lambda w: ~F.array_contains(stop, w))
    return F.array_join(kept, " ")


def aspect_tagged_text(text, aspect) -> Column:
    """``text + " [ASPECT: " + aspect + "]"`` (null-propagating)."""
    return F.concat(_c(text), F.lit(" [ASPECT: "), _c(aspect), F.lit("]"))


def absa_input(aspect, text) -> Column:
    """``lower(strip(aspect)) + " : " + text`` with null text as ''."""
    return F.concat(F.lower(py_strip(_c(aspect))), F.lit(" : "),
                    F.coalesce(_c(text), F.lit("")))
