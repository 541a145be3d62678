"""DuckDB oracle SQL for the registered queries (same keys, same columns)."""

from __future__ import annotations

from aspectra import dicts
from aspectra.plans import sqlfrag as S

ORACLE: dict[str, str] = {}


def oracle(name, sql):
    ORACLE[name] = sql.strip()


def with_corpus(body: str, terms=dicts.ASPECT_TERMS) -> str:
    return f"WITH {S.reviews_cte()}, {S.corpus_cte(terms=terms)} {body}"


def with_reviews(body: str) -> str:
    return f"WITH {S.reviews_cte()} {body}"


_EMO = S.keyword_emotion("text", "polarity")

# Flagship
oracle("aspect_sentiment_emotion_matrix", with_corpus(
    f", emo AS (SELECT aspect, polarity, {_EMO} AS emotion FROM corpus) "
    "SELECT aspect, polarity, "
    + ", ".join(f"count(*) FILTER (WHERE emotion = {S.q(e)}) AS \"{e}\"" for e in dicts.EMOTIONS)
    + " FROM emo GROUP BY aspect, polarity"))

# 2.3
oracle("normalize_polarity", with_reviews(
    f"SELECT review_id, polarity FROM (SELECT review_id, "
    f"{S.normalize_polarity('polarity_raw', strip=True)} AS polarity FROM reviews) "
    "WHERE polarity IS NOT NULL"))

oracle("normalize_target", with_reviews(
    f"SELECT review_id, {S.normalize_target('aspect_raw')} AS aspect FROM reviews"))

oracle("map_aspects", with_reviews(
    f"SELECT review_id, lang, aspect FROM (SELECT review_id, lang, "
    f"{S.map_aspect('aspect_raw')} AS aspect FROM reviews) WHERE aspect IS NOT NULL"))

oracle("map_aspects_small", with_reviews(
    f"SELECT lang, aspect, count(*) AS n FROM (SELECT lang, "
    f"{S.map_aspect('aspect_raw', dicts.ASPECT_TERMS_SMALL)} AS aspect FROM reviews) "
    "WHERE aspect IS NOT NULL GROUP BY lang, aspect"))

oracle("mapping_coverage", with_reviews(
    f"SELECT lang, count(*) AS rows_before, count(a) AS rows_after, "
    f"count(*) FILTER (WHERE a IS NULL) AS rows_dropped FROM "
    f"(SELECT lang, {S.map_aspect('aspect_raw')} AS a FROM reviews) GROUP BY lang"))

oracle("absa_input", with_corpus(
    f"SELECT review_id, lower({S.py_strip('aspect')}) || ' : ' || coalesce(text, '') "
    "AS absa_input FROM corpus"))

oracle("aspect_tagged_text", with_corpus(
    f"SELECT review_id, {S.normalize_text('text', 'lang')} || ' [ASPECT: ' || aspect || ']' "
    "AS model_text FROM corpus"))

_ENC = S.lookup([(k, str(v)) for k, v in dicts.POLARITY_CODES.items()], "polarity")
_ENC_ALT = S.lookup([(k, str(v)) for k, v in dicts.POLARITY_CODES_ALT.items()], "polarity")
oracle("encode_polarity", with_corpus(
    f"SELECT review_id, CAST({_ENC} AS INTEGER) AS label, "
    f"CAST({_ENC_ALT} AS INTEGER) AS label_alt FROM corpus"))

_EMO_CODE = S.lookup([(k, str(v)) for k, v in dicts.EMOTION_CODES.items()], "emotion")
oracle("encode_emotion", with_corpus(
    f"SELECT review_id, emotion, CAST({_EMO_CODE} AS INTEGER) AS label FROM "
    f"(SELECT review_id, {_EMO} AS emotion FROM corpus)"))

oracle("choose_model_text", with_corpus(
    f"SELECT review_id, coalesce(lower({S.py_strip('aspect')}) || ' : ' || coalesce(text, ''), '') "
    "AS model_input FROM corpus"))

oracle("filter_lang_aspect", with_corpus(
    "SELECT review_id, lang, aspect, polarity FROM corpus WHERE lang = 'fr' AND aspect = 'service'"))

oracle("drop_aspect", with_corpus("SELECT review_id, lang, polarity FROM corpus"))

oracle("drop_empty_text", with_corpus(
    f"SELECT review_id, text_processed FROM (SELECT review_id, "
    f"{S.normalize_text('text', 'lang')} AS text_processed FROM corpus) "
    "WHERE length(text_processed) > 0"))

oracle("data_gates", with_corpus(
    "SELECT lang, aspect, n_rows, n_classes, CASE WHEN n_rows < 1 THEN 'empty' "
    "WHEN n_classes < 2 THEN 'single_class' ELSE 'ok' END AS status FROM "
    "(SELECT lang, aspect, count(*) AS n_rows, count(DISTINCT polarity) AS n_classes "
    "FROM corpus GROUP BY lang, aspect)"))

# 2.9
from aspectra import fixtures as fx  # noqa: E402
from aspectra.functions import text as T  # noqa: E402
from aspectra.plans.queries import RAW_MODEL_LABELS  # noqa: E402

oracle("strip_accents", with_reviews(
    "SELECT review_id, strip_accents(lower(text)) AS text_out FROM reviews WHERE lang = 'en'"))
oracle("remove_urls", with_reviews(f"SELECT review_id, {S.rx('text', T.URL_PATTERN)} AS text_out FROM reviews"))
oracle("remove_mentions_hashtags", with_reviews(
    f"SELECT review_id, {S.rx(S.rx('text', T.MENTION_PATTERN), T.HASHTAG_PATTERN)} AS text_out FROM reviews"))
oracle("remove_punctuation", with_reviews(
    f"SELECT review_id, CASE WHEN lang = 'fr' THEN {S.rx('text', T.PUNCT_PATTERN_FR)} "
    f"ELSE {S.rx('text', T.PUNCT_PATTERN)} END AS text_out FROM reviews"))
oracle("remove_digits", with_reviews(
    f"SELECT review_id, CASE WHEN coalesce(lang, '') = 'ru' THEN text "
    f"ELSE {S.rx('text', T.DIGITS_PATTERN)} END AS text_out FROM reviews"))
oracle("collapse_whitespace", with_reviews(
    f"SELECT review_id, trim({S.rx('text', T.SPACE + '+', ' ')}) AS text_out FROM reviews"))
oracle("normalize_text", with_reviews(
    f"SELECT review_id, lang, {S.normalize_text('text', 'lang')} AS text_processed FROM reviews"))
oracle("remove_stopwords", with_reviews(
    f", n AS (SELECT review_id, lang, {S.normalize_text('text', 'lang')} AS t FROM reviews) "
    f"SELECT review_id, {S.remove_stopwords('t', 'lang')} AS text_out FROM n"))


def _lemma_sql(text: str, lang: str) -> str:
    lem = S.lookup([(f"{lg}|{tok}", lm) for lg, tok, lm in fx.LEMMAS], f"{lang} || '|' || x")
    return (f"(CASE WHEN coalesce({lang} = 'ru', false) THEN {text} ELSE "
            f"array_to_string(list_transform(CASE WHEN {text} = '' THEN []::VARCHAR[] "
            f"ELSE string_split({text}, ' ') END, lambda x: coalesce({lem}, x)), ' ') END)")


oracle("lemma_lookup", with_reviews(
    f", n AS (SELECT review_id, lang, {S.normalize_text('text', 'lang')} AS t FROM reviews) "
    f"SELECT review_id, {_lemma_sql('t', 'lang')} AS text_out FROM n"))

_CLASSIC = (f", n1 AS (SELECT review_id, lang, polarity, {S.normalize_text('text', 'lang')} AS t FROM corpus), "
            f"n2 AS (SELECT review_id, lang, polarity, {S.remove_stopwords('t', 'lang')} AS t FROM n1), "
            f"n3 AS (SELECT review_id, lang, polarity, trim({S.rx(_lemma_sql('t', 'lang'), T.SPACE + '+', ' ')}) AS t FROM n2) ")
oracle("preprocess_classic", with_corpus(
    _CLASSIC + "SELECT review_id, lang, polarity, t AS text_processed FROM n3 WHERE length(t) > 0"))

oracle("preprocess_light", with_corpus(
    f"SELECT review_id, lang, text_processed FROM (SELECT review_id, lang, "
    f"{S.normalize_text('text', 'lang')} AS text_processed FROM corpus) WHERE length(text_processed) > 0"))

oracle("texts_labels_by_lang", with_corpus(
    f", n1 AS (SELECT lang, polarity, {S.normalize_text('text', 'lang')} AS t FROM corpus), "
    f"n2 AS (SELECT lang, polarity, trim({S.rx(S.remove_stopwords('t', 'lang'), T.SPACE + '+', ' ')}) AS t FROM n1) "
    "SELECT lang, polarity, count(*) AS n FROM n2 WHERE length(t) > 0 GROUP BY lang, polarity"))

oracle("keyword_emotion", with_corpus(f"SELECT review_id, {_EMO} AS emotion FROM corpus"))
oracle("keyword_emotion_short", with_corpus(
    f"SELECT review_id, {S.keyword_emotion_short('text', 'polarity')} AS emotion FROM corpus"))
oracle("label_emotions_silver", with_corpus(
    f"SELECT review_id, {S.keyword_emotion_short('text', 'polarity')} AS emotion FROM corpus"))
oracle("map_model_label", with_corpus(
    f", r AS (SELECT *, ({S.lst(RAW_MODEL_LABELS)})[review_id % {len(RAW_MODEL_LABELS)} + 1] AS raw_label FROM corpus) "
    f"SELECT review_id, coalesce({S.lookup(dicts.MODEL_LABELS, 'lower(raw_label)')}, "
    f"{S.keyword_emotion_short('text', 'polarity')}) AS emotion FROM r"))

# 2.5 counts, 2.8 set operations
_CE = f", ce AS (SELECT *, {_EMO} AS emotion FROM corpus) "
oracle("value_counts", with_corpus(
    _CE + "SELECT dimension, value, count(*) AS n FROM ("
    "SELECT 'lang' AS dimension, lang AS value FROM ce UNION ALL "
    "SELECT 'polarity', polarity FROM ce UNION ALL SELECT 'aspect', aspect FROM ce UNION ALL "
    "SELECT 'emotion', emotion FROM ce) GROUP BY dimension, value"))
oracle("crosstab_lang_polarity", with_corpus(
    "SELECT lang, " + ", ".join(f"count(*) FILTER (WHERE polarity = {S.q(p)}) AS \"{p}\""
                                for p in dicts.POLARITIES) + " FROM corpus GROUP BY lang"))
oracle("crosstab_lang_aspect", with_corpus(
    "SELECT lang, " + ", ".join(f"count(*) FILTER (WHERE aspect = {S.q(a)}) AS \"{a}\""
                                for a in dicts.ASPECTS) + " FROM corpus GROUP BY lang"))
oracle("missing_classes", with_corpus(
    _CE + f"SELECT l.lang, e.emotion FROM (SELECT DISTINCT lang FROM ce) l, "
    f"(SELECT unnest({S.lst(dicts.EMOTIONS)}) AS emotion) e "
    "WHERE NOT EXISTS (SELECT 1 FROM ce WHERE ce.lang IS NOT DISTINCT FROM l.lang AND ce.emotion = e.emotion)"))
oracle("union_corpora", with_reviews(
    f"SELECT 'documents' AS source, review_id, lang, {S.normalize_target('aspect_raw')} AS aspect, polarity "
    f"FROM (SELECT *, {S.normalize_polarity('polarity_raw')} AS polarity FROM reviews) WHERE polarity IS NOT NULL "
    "UNION ALL SELECT 'conversations', conv_id * 1000 + turn, 'en', 'general', 'neutral' FROM conversations"))

# 2.6 / 2.10
from aspectra.functions import text as _T  # noqa: E402,F401
from aspectra.plans.queries import AUG_SYNONYMS  # noqa: E402

_POLREV = (f", prev AS (SELECT review_id, lang, text, aspect_raw, polarity FROM (SELECT *, "
           f"{S.normalize_polarity('polarity_raw')} AS polarity FROM reviews) WHERE polarity IS NOT NULL) ")


def _topk(src: str, part: str, k: str, salt: str, cols: str) -> str:
    return (f"SELECT {cols} FROM (SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY "
            f"{S.md5_key(salt, 'review_id')}, review_id) AS rn FROM {src}) WHERE rn <= {k}")


oracle("sample_per_lang", with_reviews(_POLREV + _topk("prev", "lang", "800", "sample_per_lang", "review_id, lang")))
oracle("sample_per_lang_100", with_reviews(_POLREV + _topk("prev", "lang", "100", "sample_per_lang", "review_id, lang")))


def _quota_values(target: int) -> str:
    return "(VALUES " + ", ".join(f"({S.q(p)}, {int(target * r)})" for p, r in dicts.POLARITY_QUOTA) + ") q(polarity, quota)"


def _balance(target: int) -> str:
    return with_corpus(f", cq AS (SELECT c.*, q.quota FROM corpus c JOIN {_quota_values(target)} USING (polarity)) "
                       + _topk("cq", "lang, polarity", "quota", "balance_corpus", "review_id, lang, polarity"))


oracle("balance_corpus", _balance(800))
oracle("balance_corpus_100", _balance(100))
oracle("balance_shortfall", with_corpus(
    f", g AS (SELECT l.lang, q.polarity, q.quota AS target FROM (SELECT DISTINCT lang FROM corpus) l, {_quota_values(800)}), "
    "a AS (SELECT lang, polarity, count(*) AS actual FROM corpus GROUP BY lang, polarity) "
    "SELECT g.lang, g.polarity, g.target, CAST(coalesce(a.actual, 0) AS BIGINT) AS actual FROM g "
    "LEFT JOIN a ON g.lang IS NOT DISTINCT FROM a.lang AND g.polarity = a.polarity "
    "WHERE coalesce(a.actual, 0) < g.target"))


def _rank(src: str, part: str, salt: str, idcol: str = "review_id") -> str:
    return (f"SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY {S.md5_key(salt, idcol)}, {idcol}) AS rk, "
            f"count(*) OVER (PARTITION BY {part}) AS ns FROM {src}")


oracle("split_train_val_test", with_corpus(
    f", r AS ({_rank('corpus', 'polarity', 'split')}) SELECT review_id, polarity, "
    "CASE WHEN rk <= round(ns * 0.15) THEN 'test' WHEN rk <= round(ns * 0.15) + round(ns * 0.15) THEN 'val' "
    "ELSE 'train' END AS split FROM r"))
oracle("stratified_kfold", with_corpus(
    f", r AS ({_rank('corpus', 'polarity', 'kfold')}) SELECT review_id, polarity, "
    "CAST((rk - 1) % 5 + 1 AS INTEGER) AS fold FROM r"))

_LIGHT = (f", light AS (SELECT * FROM (SELECT review_id, lang, text, aspect, polarity, "
          f"{S.normalize_text('text', 'lang')} AS text_processed FROM corpus) WHERE length(text_processed) > 0) ")
_SIZES = (", sizes AS (SELECT n_target, n_others, CAST(greatest(floor(n_others / 2) - n_target, 0) AS BIGINT) "
          "AS n_generate FROM (SELECT count(*) FILTER (WHERE polarity = 'neutral') AS n_target, "
          "count(*) FILTER (WHERE NOT coalesce(polarity = 'neutral', false)) AS n_others FROM light)) ")
oracle("augment_size", with_corpus(_LIGHT + _SIZES + "SELECT * FROM sizes"))


def _syn_sql(text: str, lang: str, rid: str) -> str:
    alts = ("(CASE " + f"{lang} || '|' || x " + " ".join(
        f"WHEN {S.q(f'{lg}|{w}')} THEN {S.lst(a)}" for lg, w, a in AUG_SYNONYMS) + " END)")
    u = f"({S.hex_int(f'md5(concat_ws(' + chr(39) + '|' + chr(39) + f', {S.q(str(dicts.SEED))}, ' + chr(39) + 'syn-u' + chr(39) + f', CAST({rid} AS VARCHAR), CAST(i - 1 AS VARCHAR)))')} / 1152921504606846976.0)"
    pick = S.hex_int(f"md5(concat_ws('|', {S.q(str(dicts.SEED))}, 'syn-pick', CAST({rid} AS VARCHAR), CAST(i - 1 AS VARCHAR)))")
    return (f"array_to_string(list_transform(CASE WHEN {text} = '' THEN []::VARCHAR[] ELSE string_split({text}, ' ') END, "
            f"lambda x, i: CASE WHEN {u} < {dicts.SYNONYM_PROB} AND {alts} IS NOT NULL "
            f"THEN ({alts})[{pick} % len({alts}) + 1] ELSE x END), ' ')")


_GEN = (", tgt AS (SELECT *, row_number() OVER (ORDER BY " + S.md5_key("augment-order", "review_id")
        + ", review_id) - 1 AS idx FROM light WHERE polarity = 'neutral'), "
        "gen AS (SELECT unnest(range(n_generate)) AS aug_id, n_target FROM sizes WHERE n_target > 0), "
        f"pick AS (SELECT aug_id, {S.hex_int(S.md5_key('augment-pick', 'aug_id'))} % n_target AS idx FROM gen), "
        f"g AS (SELECT p.aug_id, t.review_id, t.lang, t.polarity, {_syn_sql('t.text_processed', 't.lang', 'p.aug_id')} AS tp "
        "FROM pick p JOIN tgt t USING (idx)) ")
oracle("augment_class", with_corpus(
    _LIGHT + _SIZES + _GEN + "SELECT aug_id, review_id, lang, polarity, tp AS text, tp AS text_processed FROM g"))
oracle("replace_synonyms", with_corpus(
    _LIGHT + f"SELECT review_id, {_syn_sql('text_processed', 'lang', 'review_id')} AS text_out FROM light"))
oracle("balanced_union", with_corpus(
    _LIGHT + _SIZES + _GEN + "SELECT polarity, generated, count(*) AS n FROM (SELECT polarity, false AS generated FROM light "
    "UNION ALL SELECT polarity, true FROM g) GROUP BY polarity, generated"))


# 2.5 metrics
def macro_sql(src: str, keys: list[str], extra_final: str = "") -> str:
    k = ", ".join(keys)
    kc = (k + ", ") if keys else ""
    gb = f"GROUP BY {k}" if keys else ""
    return (
        f", pc AS (SELECT {kc}y_true, y_pred, count(*) AS n FROM {src} GROUP BY {kc}y_true, y_pred), "
        f"ls AS (SELECT {kc}label, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(sup) AS BIGINT) AS support, "
        f"CAST(sum(pred) AS BIGINT) AS predicted FROM (SELECT {kc}y_true AS label, n AS sup, "
        "CASE WHEN y_true = y_pred THEN n ELSE 0 END AS tp, 0 AS pred FROM pc UNION ALL "
        f"SELECT {kc}y_pred, 0, 0, n FROM pc) GROUP BY {kc}label), "
        "st AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS precision, "
        "CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall, "
        "CASE WHEN support + predicted > 0 THEN 2 * tp / (support + predicted) ELSE 0.0 END AS f1 FROM ls) "
    ), k, kc, gb


def macro_select(k, kc, gb, acc=True) -> str:
    return (f"SELECT {kc}{S.r6('avg(f1)')} AS f1_macro, {S.r6('avg(precision)')} AS precision_macro, "
            f"{S.r6('avg(recall)')} AS recall_macro, "
            + (f"{S.r6('sum(tp) / sum(support)')} AS accuracy, " if acc else "")
            + f"CAST(sum(support) AS BIGINT) AS n_samples FROM st {gb}")


def with_preds(body: str) -> str:
    return f"WITH {S.predictions_cte()} {body}"


_ms, _k, _kc, _gb = macro_sql("predictions", ["model", "lang", "aspect"])
oracle("macro_metrics", with_preds(_ms + macro_select(_k, _kc, _gb)))

_ms, _k, _kc, _gb = macro_sql("predictions", ["model"])
oracle("classification_report", with_preds(
    _ms + f"SELECT model, label, {S.r6('precision')} AS precision, {S.r6('recall')} AS recall, "
    f"{S.r6('f1')} AS f1, support FROM st UNION ALL "
    f"SELECT model, 'macro avg', {S.r6('avg(precision)')}, {S.r6('avg(recall)')}, {S.r6('avg(f1)')}, "
    "CAST(sum(support) AS BIGINT) FROM st GROUP BY model UNION ALL "
    f"SELECT model, 'weighted avg', {S.r6('sum(precision * support) / sum(support)')}, "
    f"{S.r6('sum(recall * support) / sum(support)')}, {S.r6('sum(f1 * support) / sum(support)')}, "
    "CAST(sum(support) AS BIGINT) FROM st GROUP BY model UNION ALL "
    f"SELECT model, 'accuracy', NULL, NULL, {S.r6('sum(tp) / sum(support)')}, CAST(sum(support) AS BIGINT) "
    "FROM st GROUP BY model"))

oracle("confusion_matrix", with_preds(
    ", pc AS (SELECT model, y_true, y_pred, count(*) AS n FROM predictions GROUP BY ALL), "
    f"lab AS (SELECT unnest({S.lst(dicts.POLARITIES)}) AS l) "
    "SELECT m.model, t.l AS y_true, p.l AS y_pred, CAST(coalesce(pc.n, 0) AS BIGINT) AS n "
    "FROM (SELECT DISTINCT model FROM pc) m, lab t, lab p LEFT JOIN pc ON pc.model = m.model "
    "AND pc.y_true = t.l AND pc.y_pred = p.l"))

_FOLDS = (f", pf AS (SELECT *, CAST((row_number() OVER (PARTITION BY model, y_true ORDER BY "
          f"{S.md5_key('kfold', 'row_id')}, row_id) - 1) % 5 + 1 AS INTEGER) AS fold FROM predictions) ")
_ms1, _, _, _ = macro_sql("pf", ["model", "fold"])
_fold_cte = (_FOLDS + _ms1 + ", perfold AS (" + macro_select("model, fold", "model, fold, ", "GROUP BY model, fold")
             + ") ")
_ms2 = _ms1.replace("pc AS", "pc2 AS").replace("FROM pf GROUP BY model, fold, y_true, y_pred",
                                                "FROM pf GROUP BY model, y_true, y_pred")
oracle("fold_metrics", with_preds(
    _fold_cte
    + ", pooled_pc AS (SELECT model, y_true, y_pred, count(*) AS n FROM pf GROUP BY model, y_true, y_pred), "
    "pls AS (SELECT model, label, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(sup) AS BIGINT) AS support, "
    "CAST(sum(pred) AS BIGINT) AS predicted FROM (SELECT model, y_true AS label, n AS sup, "
    "CASE WHEN y_true = y_pred THEN n ELSE 0 END AS tp, 0 AS pred FROM pooled_pc UNION ALL "
    "SELECT model, y_pred, 0, 0, n FROM pooled_pc) GROUP BY model, label), "
    "pst AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS precision, "
    "CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall, "
    "CASE WHEN support + predicted > 0 THEN 2 * tp / (support + predicted) ELSE 0.0 END AS f1 FROM pls), "
    f"pooled AS (SELECT model, {S.r6('avg(f1)')} AS f1_pooled, {S.r6('avg(precision)')} AS precision_pooled, "
    f"{S.r6('avg(recall)')} AS recall_pooled, CAST(sum(support) AS BIGINT) AS n_samples FROM pst GROUP BY model), "
    f"fs AS (SELECT model, count(*) AS n_folds, {S.r6('avg(f1_macro)')} AS f1_fold_mean, "
    f"{S.r6('stddev_pop(f1_macro)')} AS f1_fold_std, {S.r6('avg(precision_macro)')} AS precision_fold_mean, "
    f"{S.r6('avg(recall_macro)')} AS recall_fold_mean FROM perfold GROUP BY model) "
    "SELECT * FROM fs JOIN pooled USING (model)"))

oracle("class_weights", with_corpus(
    ", c AS (SELECT polarity, count(*) AS n_c FROM corpus GROUP BY polarity) "
    f"SELECT polarity, n_c, {S.r6('(SELECT sum(n_c) FROM c) / ((SELECT count(*) FROM c) * n_c)')} AS weight FROM c"))

_ms, _k, _kc, _gb = macro_sql("gp", ["lang", "aspect"])
oracle("grid_summary", with_preds(
    ", gp AS (SELECT unnest([lang, 'all']) AS lang, aspect, y_true, y_pred FROM predictions WHERE model = 'SVM') "
    + _ms + macro_select(_k, _kc, _gb, acc=False)))

# METRIC and matrices
_SHORT = f"coalesce({S.lookup(dicts.MODEL_SHORT, 'model')}, substring(model, 1, 8))"
_METRIC = (
    f", pe AS (SELECT model, {S.eval_lang('model', 'lang')} AS lang, aspect, y_true, y_pred FROM predictions), "
    "mpc AS (SELECT model, lang, aspect, y_true, y_pred, count(*) AS n FROM pe GROUP BY ALL), "
    "mpca AS (SELECT * FROM mpc UNION ALL SELECT model, lang, NULL, y_true, y_pred, CAST(sum(n) AS BIGINT) "
    "FROM mpc GROUP BY model, lang, y_true, y_pred), "
    "mls AS (SELECT model, lang, aspect, label, sum(tp) AS tp, sum(sup) AS support, sum(pred) AS predicted FROM ("
    "SELECT model, lang, aspect, y_true AS label, n AS sup, CASE WHEN y_true = y_pred THEN n ELSE 0 END AS tp, "
    "0 AS pred FROM mpca UNION ALL SELECT model, lang, aspect, y_pred, 0, 0, n FROM mpca) "
    "GROUP BY model, lang, aspect, label), "
    "mst AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS precision, "
    "CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall, "
    "CASE WHEN support + predicted > 0 THEN 2 * tp / (support + predicted) ELSE 0.0 END AS f1 FROM mls), "
    f"m0 AS (SELECT model, lang, aspect, {S.r4('avg(f1)')} AS f1_macro, {S.r4('avg(precision)')} AS precision_macro, "
    f"{S.r4('avg(recall)')} AS recall_macro, CAST(sum(support) AS BIGINT) AS n_samples FROM mst "
    "GROUP BY model, lang, aspect), "
    f"m1 AS (SELECT *, {_SHORT} AS model_short FROM m0), "
    "metric AS (SELECT *, CASE WHEN model_short = 'SVM' THEN 'svm' ELSE 'transformer' END AS family FROM m1) ")


def with_metric(body: str) -> str:
    return with_preds(_METRIC + body)


oracle("consolidate_metrics", with_metric(
    "SELECT model, model_short, family, lang, aspect, f1_macro, precision_macro, recall_macro, n_samples FROM metric"))
oracle("global_matrix", with_metric(
    "SELECT model_short, " + ", ".join(f"max(f1_macro) FILTER (WHERE lang = {S.q(l)}) AS {lab}"
                                       for l, lab in dicts.LANG_LABEL)
    + " FROM metric WHERE aspect IS NULL GROUP BY model_short"))
_EXP = (", mexp AS (SELECT model, model_short, family, unnest(CASE WHEN lang = 'all' THEN "
        f"{S.lst(dicts.LANGUAGES)} ELSE [lang] END) AS lang, aspect, f1_macro FROM metric WHERE aspect IS NOT NULL) ")
oracle("expand_all_lang", with_metric(_EXP + "SELECT model_short, lang, aspect, f1_macro FROM mexp"))
_ALONG = (_EXP + ", along AS (SELECT aspect, lang, model_short, model_short || '(' || upper(lang) || ')' AS col_label, "
          f"max(f1_macro) AS f1_macro FROM mexp WHERE aspect IN ({', '.join(S.q(a) for a in dicts.ASPECTS)}) "
          "GROUP BY ALL) ")
from aspectra.operators.matrices import matrix_columns  # noqa: E402
oracle("absa_matrix", with_metric(
    _ALONG + "SELECT aspect, " + ", ".join(f"max(f1_macro) FILTER (WHERE col_label = {S.q(c)}) AS \"{c}\""
                                          for c in matrix_columns()) + " FROM along GROUP BY aspect"))
oracle("gain_vs_baseline", with_metric(
    _ALONG + "SELECT a.aspect, a.lang, a.model_short, a.col_label, "
    f"{S.r4('a.f1_macro - b.f1_macro')} AS gain FROM along a JOIN along b ON a.aspect = b.aspect "
    "AND a.lang = b.lang AND b.model_short = 'SVM' WHERE a.model_short <> 'SVM'"))
_CMP = (", cmp AS (SELECT concat_ws('_', family, replace(model, '/', '_'), coalesce(lang, 'N/A')) AS name, "
        "coalesce(lang, 'N/A') AS lang, coalesce(f1_macro, 0.0) AS macro_f1, coalesce(precision_macro, 0.0) AS precision, "
        "coalesce(recall_macro, 0.0) AS recall, CAST(coalesce(n_samples, 0) AS BIGINT) AS n_samples, "
        "model AS model_name, family FROM metric WHERE aspect IS NULL) ")
oracle("comparison_table", with_metric(_CMP + "SELECT * FROM cmp"))
oracle("best_model", with_metric(_CMP + "SELECT * FROM cmp ORDER BY macro_f1 DESC, name LIMIT 1"))
_FS = (", fs AS (SELECT family, " + S.r4("avg(macro_f1)") + " AS mean_f1, "
       "first(name ORDER BY macro_f1 DESC, name) AS best_name, max(macro_f1) AS best_f1, count(*) AS n_results "
       "FROM cmp GROUP BY family) ")
oracle("family_summary", with_metric(_CMP + _FS + "SELECT * FROM fs"))
oracle("best_per_lang", with_metric(
    _CMP + ", l AS (SELECT DISTINCT lang FROM cmp WHERE lang <> 'N/A'), "
    f"f AS (SELECT unnest({S.lst(['svm', 'transformer'])}) AS family), "
    "b AS (SELECT lang, family, max(macro_f1) AS best_f1 FROM cmp WHERE lang <> 'N/A' GROUP BY ALL) "
    "SELECT l.lang, f.family, coalesce(b.best_f1, 0.0) AS best_f1 FROM l, f "
    "LEFT JOIN b ON b.lang = l.lang AND b.family = f.family"))
oracle("evaluation_report", with_metric(
    _CMP + _FS + "SELECT * FROM (SELECT 'best_model' AS section, NULL::VARCHAR AS family, name, macro_f1 AS value "
    "FROM cmp ORDER BY macro_f1 DESC, name LIMIT 1) UNION ALL "
    "SELECT 'family_mean', family, NULL, mean_f1 FROM fs UNION ALL "
    "SELECT 'family_best', family, best_name, best_f1 FROM fs"))

# TF-IDF
from aspectra.operators.features import TOKEN_PATTERN  # noqa: E402
_TF = (_CLASSIC + ", docs AS (SELECT review_id, t FROM n3 WHERE length(t) > 0), "
       f"toks AS (SELECT review_id, regexp_extract_all(t, {S.q(TOKEN_PATTERN)}) AS tk FROM docs), "
       "terms AS (SELECT review_id, unnest(list_concat(tk, list_transform(range(1, len(tk)), "
       "lambda i: tk[i] || ' ' || tk[i + 1]))) AS term FROM toks), "
       "tf AS (SELECT review_id, term, count(*) AS tf FROM terms GROUP BY ALL), "
       "dfq AS (SELECT term, count(review_id) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM tf GROUP BY term), "
       f"vocab AS (SELECT term, df, cf FROM dfq WHERE df >= {dicts.TFIDF_MIN_DF} ORDER BY cf DESC, term "
       f"LIMIT {dicts.TFIDF_MAX_FEATURES}) ")
oracle("vocabulary_topk", with_corpus(_TF + "SELECT term, df, cf FROM vocab"))
oracle("tfidf_terms", with_corpus(
    _TF + ", nd AS (SELECT count(*) AS n FROM docs), "
    "w AS (SELECT tf.review_id, tf.term, tf.tf, tf.tf * (ln((1.0 + n) / (1.0 + df)) + 1.0) AS w "
    "FROM tf JOIN vocab USING (term), nd) "
    f"SELECT review_id, term, tf, {S.r6('w / sqrt(sum(w * w) OVER (PARTITION BY review_id))')} AS weight FROM w"))

# 2.1 sources / 2.2 sinks
from aspectra.plans.derived import CSV_LABELS  # noqa: E402


def macro_cte(p: str, src: str, keys: list[str]) -> str:
    """CTEs {p}pc, {p}ls, {p}st, {p}m: macro metrics (6 decimals) per keys."""
    k = ", ".join(keys)
    return (
        f", {p}pc AS (SELECT {k}, y_true, y_pred, count(*) AS n FROM {src} GROUP BY {k}, y_true, y_pred), "
        f"{p}ls AS (SELECT {k}, label, sum(tp) AS tp, sum(sup) AS support, sum(pred) AS predicted FROM ("
        f"SELECT {k}, y_true AS label, n AS sup, CASE WHEN y_true = y_pred THEN n ELSE 0 END AS tp, 0 AS pred "
        f"FROM {p}pc UNION ALL SELECT {k}, y_pred, 0, 0, n FROM {p}pc) GROUP BY {k}, label), "
        f"{p}st AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS precision, "
        "CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall, "
        f"CASE WHEN support + predicted > 0 THEN 2 * tp / (support + predicted) ELSE 0.0 END AS f1 FROM {p}ls), "
        f"{p}m AS (SELECT {k}, {S.r6('avg(f1)')} AS f1_macro, {S.r6('avg(precision)')} AS precision_macro, "
        f"{S.r6('avg(recall)')} AS recall_macro, {S.r6('sum(tp) / sum(support)')} AS accuracy, "
        f"CAST(sum(support) AS BIGINT) AS n_samples FROM {p}st GROUP BY {k}) ")


_OPS = (
    ", s AS (SELECT review_id % 5 AS bucket, text, aspect_raw AS t1, "
    "CASE WHEN review_id % 5 = 4 THEN 'conflict' ELSE polarity_raw END AS p1, "
    f"({S.lst(fx.RAW_ASPECTS)})[(review_id + 5) % 12 + 1] AS t2, "
    f"CASE WHEN review_id % 5 = 4 THEN 'conflict' ELSE ({S.lst(fx.RAW_POLARITIES)})[((review_id // 12) + 3) % 8 + 1] END AS p2 "
    "FROM reviews), "
    f"st AS (SELECT bucket, {S.py_strip('text')} AS text, t1, p1, t2, p2 FROM s WHERE text IS NOT NULL AND text <> ''), "
    "ops AS (SELECT bucket, text, t1 AS t, p1 AS p FROM st UNION ALL SELECT bucket, text, t2, p2 FROM st), "
    f"valid AS (SELECT * FROM (SELECT bucket, text, {S.normalize_target('t')} AS aspect, "
    f"{S.normalize_polarity('p')} AS polarity FROM ops) WHERE polarity IS NOT NULL), "
    "fb AS (SELECT text FROM st WHERE bucket NOT IN (SELECT DISTINCT bucket FROM valid)) ")
_OP_ROWS = ("SELECT text, aspect, polarity, 'fr' AS lang FROM valid UNION ALL "
            "SELECT text, 'general', 'neutral', 'fr' FROM fb")
oracle("read_opinion_xml", with_reviews(_OPS + _OP_ROWS))
oracle("whole_text_fallback", with_reviews(_OPS + "SELECT text, 'general' AS aspect, 'neutral' AS polarity, 'fr' AS lang FROM fb"))

_TERMS = (
    ", ts AS (SELECT CASE review_id % 3 WHEN 0 THEN 'fr_reviews' WHEN 1 THEN 'en_laptops' ELSE 'en_conflicts' END AS src, "
    "text, aspect_raw AS term, CASE WHEN review_id % 3 = 2 THEN 'conflict' ELSE polarity_raw END AS p, "
    "review_id % 7 = 0 AS noterms FROM reviews), "
    f"tst AS (SELECT src, {S.py_strip('text')} AS text, term, p, noterms FROM ts WHERE text IS NOT NULL AND text <> ''), "
    f"tvalid AS (SELECT * FROM (SELECT src, text, {S.py_strip('term')} AS aspect, {S.normalize_polarity('p')} AS polarity "
    "FROM tst WHERE NOT noterms AND term IS NOT NULL AND term <> '') WHERE polarity IS NOT NULL), "
    "tfb AS (SELECT src, text FROM tst WHERE src NOT IN (SELECT DISTINCT src FROM tvalid)) ")
oracle("read_aspect_term_xml", with_reviews(
    _TERMS + "SELECT text, aspect, polarity, 'en' AS lang FROM tvalid UNION ALL "
    "SELECT text, 'general', 'neutral', 'en' FROM tfb"))

_CSV = (f", cs AS (SELECT {S.py_strip('text')} AS text, ({S.lst(CSV_LABELS)})[review_id % {len(CSV_LABELS)} + 1] AS label "
        "FROM reviews), "
        f"crow AS (SELECT * FROM (SELECT text, 'general' AS aspect, {S.normalize_polarity('label', strip=True)} AS polarity, "
        "'ru' AS lang FROM cs) WHERE polarity IS NOT NULL AND text IS NOT NULL AND length(text) > 0) ")
oracle("read_labelled_csv", with_reviews(_CSV + "SELECT * FROM crow"))
_MIXED = (", cs AS (SELECT ['Это é', 'жук', 'déjà ' || chr(152)][review_id % 3 + 1] || ' ' || regexp_replace(text, '[^\\x00-\\x7F]', '', 'g') AS t, "
          f"({S.lst(CSV_LABELS)})[review_id % {len(CSV_LABELS)} + 1] AS label FROM reviews), "
          f"crow AS (SELECT * FROM (SELECT {S.py_strip('t')} AS text, 'general' AS aspect, {S.normalize_polarity('label', strip=True)} AS polarity, "
          "'ru' AS lang FROM cs) WHERE polarity IS NOT NULL AND text IS NOT NULL AND length(text) > 0) ")
oracle("read_labelled_csv_encodings", with_reviews(_MIXED + "SELECT * FROM crow"))
oracle("detect_columns", "SELECT 'Text' AS text_col, 'Label' AS label_col FROM (SELECT 1 FROM documents LIMIT 1)")
oracle("route_inputs", with_reviews(
    _OPS + _TERMS + _CSV + _OP_ROWS + " UNION ALL "
    "SELECT text, aspect, polarity, CASE WHEN src = 'fr_reviews' THEN 'fr' ELSE 'en' END FROM tvalid UNION ALL "
    "SELECT text, 'general', 'neutral', CASE WHEN src = 'fr_reviews' THEN 'fr' ELSE 'en' END FROM tfb "
    "UNION ALL SELECT * FROM crow"))

_CORPUS_ROWS = "SELECT review_id, lang, text, aspect, polarity FROM corpus"
oracle("write_corpus", with_corpus(_CORPUS_ROWS))
oracle("write_corpus_csv", with_corpus(_CORPUS_ROWS))
oracle("scan_corpus", with_corpus(_CORPUS_ROWS))
oracle("scan_first_available", with_corpus(_CORPUS_ROWS))

_SVMP = (", svmp AS (SELECT unnest([lang, 'all']) AS lang, aspect, y_true, y_pred FROM predictions "
         "WHERE model = 'SVM') " + macro_cte("s_", "svmp", ["lang", "aspect"]))
oracle("write_results", with_preds(
    _SVMP + "SELECT m.lang, m.aspect, m.f1_macro AS global_f1_macro, m.precision_macro AS global_precision_macro, "
    "m.recall_macro AS global_recall_macro, m.n_samples, 5 AS n_folds, m.n_samples AS cm_total, "
    f"{S.r6('st.f1')} AS report_pos_f1 FROM s_m m LEFT JOIN s_st st ON st.lang = m.lang AND st.aspect = m.aspect "
    "AND st.label = 'pos'"))
oracle("scan_svm_metrics", with_preds(
    _SVMP + f"SELECT 'SVM' AS model, lang, aspect, {S.r4('f1_macro')} AS f1_macro, "
    f"{S.r4('precision_macro')} AS precision_macro, {S.r4('recall_macro')} AS recall_macro, n_samples FROM s_m"))
_MODP = (f", modp AS (SELECT model, {S.eval_lang('model', 'lang')} AS lang, aspect, y_true, y_pred FROM predictions "
         "WHERE model <> 'SVM') " + macro_cte("o_", "modp", ["model", "lang"])
         + macro_cte("a_", "modp", ["model", "lang", "aspect"]))
oracle("scan_model_metrics", with_preds(
    _MODP + f"SELECT model, lang, NULL::VARCHAR AS aspect, {S.r4('f1_macro')} AS f1_macro, "
    f"{S.r4('precision_macro')} AS precision_macro, {S.r4('recall_macro')} AS recall_macro, n_samples FROM o_m "
    f"UNION ALL SELECT model, lang, aspect, {S.r4('f1_macro')}, NULL::DOUBLE, NULL::DOUBLE, NULL::BIGINT FROM a_m"))
oracle("scan_results", with_preds(
    _SVMP + _MODP + "SELECT 'svm_' || lang || '_' || aspect AS name, lang, f1_macro AS macro_f1, "
    "precision_macro AS precision, recall_macro AS recall, n_samples, '' AS model_name, 'svm' AS family FROM s_m "
    "UNION ALL SELECT 'transformer_' || replace(model, '/', '_') || '_' || lang, lang, f1_macro, precision_macro, "
    "recall_macro, n_samples, model, 'transformer' FROM o_m"))
oracle("write_matrix", ORACLE["absa_matrix"])

oracle("tfidf_vectors", with_corpus(
    _TF + ", nd AS (SELECT count(*) AS n FROM docs), "
    "w AS (SELECT tf.review_id, tf.term, tf.tf * (ln((1.0 + n) / (1.0 + df)) + 1.0) AS w "
    "FROM tf JOIN vocab USING (term), nd) "
    f"SELECT review_id, term, {S.r6('w / sqrt(sum(w * w) OVER (PARTITION BY review_id))')} AS weight FROM w"))

oracle("write_report", with_metric(
    _CMP + _FS + ", rep AS (SELECT * FROM (SELECT 'best_model' AS section, NULL::VARCHAR AS family, name, "
    "macro_f1 AS value FROM cmp ORDER BY macro_f1 DESC, name LIMIT 1) UNION ALL "
    "SELECT 'family_mean', family, NULL, mean_f1 FROM fs UNION ALL "
    "SELECT 'family_best', family, best_name, best_f1 FROM fs) "
    "SELECT concat_ws(' | ', section, coalesce(family, '-'), coalesce(name, '-'), printf('%.4f', value)) AS line FROM rep"))

# Classifiers: what doesn't depend on the fits.
oracle("svm_task_vocabulary", with_corpus(
    _CLASSIC + ", docs AS (SELECT n3.review_id, n3.lang || '#' || aspect AS task, t FROM n3 JOIN corpus USING (review_id) WHERE length(t) > 0), "
    "toks AS (SELECT review_id, task, regexp_extract_all(t, '[\\p{L}\\p{N}_]{2,}') AS tk FROM docs), "
    "terms AS (SELECT review_id, task, unnest(list_concat(tk, list_transform(range(1, len(tk)), lambda i: tk[i] || ' ' || tk[i + 1]))) AS term FROM toks), "
    "counts AS (SELECT task, term, count(DISTINCT review_id) AS df, count(*) AS cf FROM terms GROUP BY ALL HAVING count(DISTINCT review_id) >= 2), "
    "ranked AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY cf DESC, term) AS rk FROM counts), "
    "sizes AS (SELECT task, count(*) AS n_task FROM docs GROUP BY task) "
    f"SELECT task, term, df, cf, n_task, {S.r6('ln((1.0 + n_task) / (1.0 + df)) + 1.0')} AS idf FROM ranked JOIN sizes USING (task) WHERE rk <= 300"))
oracle("classifier_facts", with_corpus(
    _CLASSIC + _LIGHT + ", g AS (SELECT 'svm' AS classifier, 'all' AS run, polarity AS y FROM n3 WHERE length(t) > 0 "
    f"UNION ALL SELECT 'emotion', unnest([lang, 'all']), {_EMO} FROM corpus UNION ALL SELECT 'sentiment', unnest([lang, 'all']), polarity FROM light), "
    "big AS (SELECT classifier, run FROM g WHERE run IN ('fr', 'all', 'ru') GROUP BY ALL HAVING classifier <> 'emotion' OR count(*) >= 30), "
    "c AS (SELECT classifier, run, y, count(*) AS n, CAST(round(count(*) * 0.15) AS BIGINT) AS nt FROM g JOIN big USING (classifier, run) GROUP BY ALL) "
    "SELECT classifier, run, CAST(sum(n - nt - least(nt, n - nt)) AS BIGINT) AS n_train, CAST(sum(least(nt, n - nt)) AS BIGINT) AS n_val, "
    f"CAST(sum(nt) AS BIGINT) AS n_test, CAST(sum(nt) AS BIGINT) AS n_predicted, {S.r6('max(nt) / sum(nt)')} AS majority_accuracy FROM c GROUP BY classifier, run"))

# the corpus chain, tables of synonyms, scored emotions, the whole report
oracle("build_clean_corpus", with_corpus(
    f", cq AS (SELECT c.*, lower({S.py_strip('aspect')}) || ' : ' || coalesce(text, '') AS absa_input, q.quota "
    f"FROM corpus c JOIN {_quota_values(dicts.TARGET_PER_LANG)} USING (polarity)) "
    + _topk("cq", "lang, polarity", "quota", "balance_corpus", "review_id, lang, aspect, polarity, absa_input")))
oracle("language_gates", with_corpus(
    f", seen AS (SELECT lang, count(*) AS n_rows, count(DISTINCT polarity) AS n_classes FROM corpus GROUP BY lang UNION ALL "
    f"SELECT unnest({S.lst([*dicts.LANGUAGES, 'it'])}), 0, 0), "
    "g AS (SELECT lang, max(n_rows) AS n_rows, max(n_classes) AS n_classes, CAST(CASE WHEN lang = 'ru' THEN 100 ELSE 30 END AS BIGINT) AS need FROM seen GROUP BY lang) "
    "SELECT *, CASE WHEN n_rows = 0 THEN 'empty' WHEN n_rows < need THEN 'scarce' WHEN n_classes < 2 THEN 'single_class' ELSE 'ok' END AS status FROM g"))
oracle("emotion_input", with_corpus(
    f", e AS (SELECT review_id, {_EMO} AS emotion, coalesce(text, '') AS model_input FROM corpus WHERE lang = 'en' AND review_id % 7 > 0) "
    f"SELECT review_id, emotion, CAST(list_position({S.lst(dicts.EMOTIONS)}, emotion) - 1 AS INTEGER) AS label, model_input FROM e"))
_DRAW = S.hex_int(f"md5(concat_ws('|', {S.q(str(dicts.SEED))}, '{{}}', CAST(review_id AS VARCHAR), CAST(i AS VARCHAR)))")
oracle("replace_synonyms_from", with_corpus(
    _LIGHT + ", tok AS (SELECT review_id, lang, unnest(string_split(text_processed, ' ')) AS w, unnest(range(len(string_split(text_processed, ' ')))) AS i FROM light) "
    f"SELECT review_id, string_agg(CASE WHEN {_DRAW.format('syn-u')} / 1152921504606846976.0 < {dicts.SYNONYM_PROB} AND length(w) >= 4 AND lang IS NOT NULL "
    f"THEN (list_sort([w || 's', 'x' || w]))[{_DRAW.format('syn-pick')} % 2 + 1] ELSE w END, ' ' ORDER BY i) AS text_out FROM tok GROUP BY review_id"))
oracle("label_emotions_scored", with_corpus(
    f", r AS (SELECT *, ({S.lst(RAW_MODEL_LABELS)})[length({S.silver_text('text')}) % {len(RAW_MODEL_LABELS)} + 1] AS raw_label FROM corpus) "
    f"SELECT review_id, coalesce({S.lookup(dicts.MODEL_LABELS, 'lower(raw_label)')}, {S.keyword_emotion_short('text', 'polarity')}) AS emotion FROM r"))
oracle("texts_and_labels", with_corpus(
    f", n1 AS (SELECT review_id, lang, polarity, {S.normalize_text('text', 'lang')} AS t FROM corpus), "
    f"n2 AS (SELECT review_id, lang, polarity, trim({S.rx(S.remove_stopwords('t', 'lang'), T.SPACE + '+', ' ')}) AS t FROM n1) "
    "SELECT review_id, lang, t AS text, polarity AS label FROM n2 WHERE length(t) > 0"))
_ROW = "family, name, lang, macro_f1, precision, recall, n_samples, model_name"
oracle("full_report", with_metric(
    _CMP + f"SELECT * FROM (SELECT 'best_model' AS section, {_ROW} FROM cmp ORDER BY macro_f1 DESC, name LIMIT 1) "
    f"UNION ALL SELECT 'table', {_ROW} FROM cmp "
    f"UNION ALL SELECT 'family_mean', family, NULL, NULL, {S.r4('avg(macro_f1)')}, NULL, NULL, count(*), NULL FROM cmp GROUP BY family "
    f"UNION ALL SELECT 'family_best', {_ROW} FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY macro_f1 DESC, name) AS rn FROM cmp) WHERE rn = 1"))
