"""Metrics on hand-computed examples (no scikit-learn here)."""
import pytest

from aspectra.operators import metrics as M


def preds(spark):
    # y_true / y_pred; class 'neutral' is never predicted
    rows = [("pos", "pos"), ("pos", "pos"), ("pos", "neg"), ("neg", "neg"), ("neg", "pos"),
            ("neutral", "pos"), ("neutral", "neg")]
    return spark.createDataFrame(rows, "y_true string, y_pred string")


def test_macro_metrics_by_hand(spark):
    r = M.macro_metrics(preds(spark)).first()
    # pos: tp2 pred4 sup3 -> p .5 r .6667 f1 4/7 ; neg: tp1 pred3 sup2 -> p .3333 r .5 f1 .4 ; neutral: 0
    assert r.precision_macro == pytest.approx(round((0.5 + 1 / 3 + 0) / 3, 6))
    assert r.recall_macro == pytest.approx(round((2 / 3 + 0.5 + 0) / 3, 6))
    assert r.f1_macro == pytest.approx(round((4 / 7 + 0.4 + 0) / 3, 6))
    assert r.accuracy == pytest.approx(round(3 / 7, 6)) and r.n_samples == 7


def test_confusion_sums_to_n_and_keeps_zero_cells(spark):
    cm = M.confusion_matrix(preds(spark)).collect()
    assert len(cm) == 9 and sum(r.n for r in cm) == 7
    assert {(r.y_true, r.y_pred): r.n for r in cm}[("neutral", "neutral")] == 0


def test_report_rows(spark):
    rep = {r.label: r for r in M.classification_report(preds(spark)).collect()}
    assert set(rep) == {"pos", "neg", "neutral", "macro avg", "weighted avg", "accuracy"}
    assert rep["neutral"].f1 == 0.0 and rep["accuracy"].support == 7


def test_fold_metrics_pooled_is_not_mean(spark):
    rows = [(f, t, p) for f in (1, 2) for t, p in [("pos", "pos"), ("neg", "pos")] * f]
    df = spark.createDataFrame(rows, "fold int, y_true string, y_pred string")
    r = M.fold_metrics(df).first()
    assert r.n_folds == 2 and r.n_samples == 6 and r.f1_fold_std == pytest.approx(0.0)


def test_class_weights_sum_to_n(spark):
    df = spark.createDataFrame([("a",)] * 6 + [("b",)] * 3 + [("c",)], "polarity string")
    w = {r.polarity: (r.weight, r.n_c) for r in M.class_weights(df).collect()}
    assert sum(wt * n for wt, n in w.values()) == pytest.approx(10)
    assert w["c"][0] == pytest.approx(round(10 / 3, 6))


def _metric_rows(spark):
    rows = [("SVM", "svm", "fr", "prix", 0.5), ("SVM", "svm", "fr", None, 0.6), ("XLM-R", "transformer", "all", "service", 0.7),
            ("GPT", "transformer", "de", "prix", 0.8), ("GPT", "transformer", "fr", "qualité", 0.9), ("GPT", "transformer", "de", None, 0.4),
            ("GPT", "transformer", "de", None, 0.45), ("SVM", "svm", "fr", "unlisted aspect", 0.1)]
    return spark.createDataFrame(rows, "model_short string, family string, lang string, aspect string, f1_macro double")


def test_matrices_keep_unlisted_models_and_languages(spark):
    """Unlisted columns follow the listed ones in order; rows are in category order."""
    from aspectra import dicts
    from aspectra.operators import matrices as MX
    m = MX.absa_matrix(_metric_rows(spark))
    assert m.columns == ["aspect", *MX.matrix_columns(), "GPT(DE)", "GPT(FR)"]
    rows = m.collect()
    assert [r.aspect for r in rows] == [a for a in dicts.ASPECTS if a in ("qualité", "service", "prix")]
    assert rows[-1]["GPT(DE)"] == 0.8 and rows[0]["GPT(FR)"] == 0.9 and rows[1]["XLM-R(RU)"] == 0.7
    g = MX.global_matrix(_metric_rows(spark))
    assert g.columns == ["model_short", *[lab for _, lab in dicts.LANG_LABEL], "DE"]
    assert {r.model_short: r["DE"] for r in g.collect()} == {"SVM": None, "GPT": 0.45}


def test_confusion_matrix_keeps_unlisted_labels(spark):
    from aspectra.operators import metrics as M
    df = spark.createDataFrame([("a", "pos", "pos"), ("a", "odd", "neg"), ("b", "neg", "neg")], "k string, y_true string, y_pred string")
    got = {tuple(r) for r in M.confusion_matrix(df, ["k"]).collect()}
    assert sum(r[3] for r in got) == 3 and ("a", "odd", "neg", 1) in got and ("a", "pos", "odd", 0) in got
    assert len([r for r in got if r[0] == "a"]) == 16 and len([r for r in got if r[0] == "b"]) == 9
