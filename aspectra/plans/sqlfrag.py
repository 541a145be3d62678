"""SQL fragments (DuckDB dialect) that state the oracle side of each operator.

They are built from the same fixed values as the Spark operators, so a
dictionary change moves both sides.  Used only by ``plans/oracle.py``.
"""

from __future__ import annotations

from aspectra import dicts
from aspectra import fixtures as fx
from aspectra.functions import text as T


def q(s) -> str:
    if s is None:
        return "NULL"
    return "'" + str(s).replace("'", "''") + "'"


def lst(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def lookup(pairs, expr: str) -> str:
    whens = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in pairs)
    return f"(CASE {expr} {whens} END)"


def rx(expr: str, pattern: str, repl: str = "") -> str:
    return f"regexp_replace({expr}, {q(pattern)}, {q(repl)}, 'g')"


def py_strip(expr: str) -> str:
    return rx(expr, f"^{T.SPACE}+|{T.SPACE}+$")


def normalize_polarity(expr: str, strip: bool = False) -> str:
    v = f"lower({expr})"
    if strip:
        v = py_strip(v)
    return lookup(dicts.POLARITY_SPELLINGS, v)


def normalize_target(expr: str) -> str:
    return (f"(CASE WHEN {expr} IS NULL OR {expr} = '' OR {expr} = 'NULL' "
            f"THEN 'general' ELSE {py_strip(expr)} END)")


def map_aspect(expr: str, terms=dicts.ASPECT_TERMS) -> str:
    return lookup(terms, f"lower({py_strip(expr)})")


def has_any(text_lower: str, words) -> str:
    return "(" + " OR ".join(f"coalesce(contains({text_lower}, {q(w)}), false)"
                             for w in words) + ")"


def keyword_emotion(text: str, pol: str, kw=dicts.EMOTION_KEYWORDS) -> str:
    t = f"lower({text})"
    return (f"(CASE WHEN {pol} = 'pos' THEN (CASE WHEN {has_any(t, kw['joie'])} THEN 'joie' ELSE 'satisfaction' END) "
            f"WHEN {pol} = 'neg' THEN (CASE WHEN {has_any(t, kw['colère'])} THEN 'colère' "
            f"WHEN {has_any(t, kw['tristesse'])} THEN 'tristesse' ELSE 'insatisfaction' END) "
            f"ELSE (CASE WHEN {has_any(t, kw['insatisfaction'])} THEN 'insatisfaction' ELSE 'satisfaction' END) END)")


def silver_text(text: str) -> str:
    t = f"coalesce({text}, '')"
    return f"(CASE WHEN {py_strip(t)} = '' THEN '.' ELSE {t} END)"


def keyword_emotion_short(text: str, pol: str) -> str:
    return keyword_emotion(silver_text(text), f"coalesce({pol}, 'neutral')",
                           dicts.EMOTION_KEYWORDS_SHORT)


def strip_accents(expr: str) -> str:
    return f"strip_accents({expr})"


def normalize_text(text: str, lang: str) -> str:
    t = f"lower(coalesce({text}, ''))"
    t = f"(CASE WHEN {lang} = 'en' THEN {strip_accents(t)} ELSE {t} END)"
    t = rx(t, T.URL_PATTERN)
    t = rx(rx(t, T.MENTION_PATTERN), T.HASHTAG_PATTERN)
    t = f"(CASE WHEN {lang} = 'fr' THEN {rx(t, T.PUNCT_PATTERN_FR)} ELSE {rx(t, T.PUNCT_PATTERN)} END)"
    t = f"(CASE WHEN coalesce({lang}, '') = 'ru' THEN {t} ELSE {rx(t, T.DIGITS_PATTERN)} END)"
    return f"trim({rx(t, T.SPACE + '+', ' ')})"


def stop_list(lang: str, custom=()) -> str:
    whens = " ".join(f"WHEN {q(lg)} THEN {lst(sorted(set(ws) | set(custom)))}"
                     for lg, ws in dicts.STOPWORDS.items())
    return f"(CASE {lang} {whens} ELSE {lst(sorted(set(custom)))}::VARCHAR[] END)"


def remove_stopwords(text: str, lang: str) -> str:
    return (f"array_to_string(list_filter(CASE WHEN {text} = '' THEN []::VARCHAR[] "
            f"ELSE string_split({text}, ' ') END, "
            f"lambda x: NOT list_contains({stop_list(lang)}, x)), ' ')")


def reviews_cte() -> str:
    return (
        "reviews AS (SELECT doc_id AS review_id, "
        "CASE WHEN lang = 'de' THEN 'ru' ELSE lang END AS lang, "
        f"({lst(fx.RAW_ASPECTS)})[doc_id % 12 + 1] AS aspect_raw, "
        f"({lst(fx.RAW_POLARITIES)})[(doc_id // 12) % 8 + 1] AS polarity_raw, "
        f"({lst(fx.PHRASES)})[doc_id % 13 + 1] || ' ' || text AS text "
        "FROM documents)"
    )


def corpus_cte(name: str = "corpus", src: str = "reviews", terms=dicts.ASPECT_TERMS) -> str:
    """reviews -> normalised polarity -> mapped aspect (drops unmapped/invalid)."""
    return (
        f"{name} AS (SELECT review_id, lang, text, aspect, polarity FROM ("
        f"SELECT review_id, lang, text, {map_aspect('aspect_raw', terms)} AS aspect, "
        f"{normalize_polarity('polarity_raw')} AS polarity FROM {src}) "
        "WHERE aspect IS NOT NULL AND polarity IS NOT NULL)"
    )


def predictions_cte() -> str:
    y_true = lookup(fx.FLAG_TO_POLARITY, "l_returnflag")
    return (
        "predictions AS (SELECT concat_ws('-', CAST(l_orderkey AS VARCHAR), CAST(l_partkey AS VARCHAR), "
        "CAST(l_suppkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), l_returnflag) AS row_id, "
        f"({lst(fx.PRED_MODELS)})[l_orderkey % 4 + 1] AS model, "
        f"({lst(fx.PRED_LANGS)})[l_suppkey % 3 + 1] AS lang, "
        f"({lst(dicts.ASPECTS)})[l_partkey % 5 + 1] AS aspect, "
        f"{y_true} AS y_true, "
        f"CASE WHEN (l_partkey + l_linenumber) % 10 < 6 THEN {y_true} "
        f"ELSE ({lst(fx.PRED_LABELS)})[l_linenumber % 3 + 1] END AS y_pred "
        "FROM lineitem)"
    )


def eval_lang(model: str, lang: str) -> str:
    return f"(CASE WHEN {model} = {q(fx.MULTILINGUAL_MODEL)} THEN 'all' ELSE {lang} END)"


def md5_key(salt: str, *ids: str, seed: int = dicts.SEED) -> str:
    parts = ", ".join([q(str(seed)), q(salt)] + [f"CAST({i} AS VARCHAR)" for i in ids])
    return f"md5(concat_ws('|', {parts}))"


def hex_int(hexexpr: str, digits: int = 15) -> str:
    return f"CAST(('0x' || substr({hexexpr}, 1, {digits})) AS BIGINT)"


def r6(expr: str) -> str:
    return f"round_even({expr}, 6)"


def r4(expr: str) -> str:
    return f"round_even({expr}, 4)"
