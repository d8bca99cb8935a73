import numpy as np
import pytest
from pyspark.sql import functions as F

from tabsight.operators import metrics as M


def frame(spark, y, p, model="m"):
    return spark.createDataFrame([(i, i % 3, model, int(a), float(b)) for i, (a, b) in enumerate(zip(y, p))],
                                 "id long, fold int, model string, y_true int, y_pred double")


def brute_auc(y, p):
    pos, neg = p[y == 1], p[y == 0]
    return np.mean((pos[:, None] > neg[None, :]) + 0.5 * (pos[:, None] == neg[None, :]))


def brute_ap(y, p):
    out, last = 0.0, 0.0
    for t in sorted(set(p), reverse=True):
        hit = p >= t
        recall = y[hit].sum() / y.sum()
        out += (recall - last) * y[hit].mean()
        last = recall
    return out


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(4)
    y = (rng.random(600) < 0.4).astype(int)
    # a third of the rows share one score
    p = np.where(rng.random(600) < 0.33, 0.5, np.clip(np.round(0.3 * y + 0.5 * rng.random(600), 2), 0, 1))
    return y, p


@pytest.mark.parametrize("cells", [2, 50])
def test_ranked_metrics_against_brute_force(spark, data, cells):
    y, p = data
    c = M.score_counts(frame(spark, y, p))
    assert M.roc_auc(c, ["model"], cells=cells).first()["roc_auc"] == pytest.approx(brute_auc(y, p))
    assert M.average_precision(c, ["model"], cells=cells).first()["pr_auc"] == pytest.approx(brute_ap(y, p))


def test_auc_ignores_monotone_transforms(spark, data):
    y, p = data
    a = M.roc_auc(M.score_counts(frame(spark, y, p)), ["model"]).first()["roc_auc"]
    b = M.roc_auc(M.score_counts(frame(spark, y, np.exp(3 * p))), ["model"]).first()["roc_auc"]
    assert a == pytest.approx(b)


def test_single_class_has_no_auc(spark):
    c = M.score_counts(frame(spark, [1, 1], [0.2, 0.4]))
    assert M.roc_auc(c, ["model"]).first()["roc_auc"] is None
    assert M.average_precision(M.score_counts(frame(spark, [0, 0], [0.2, 0.4])), ["model"]).first()["pr_auc"] is None


def test_grid_threshold_lowest_wins_and_default(spark):
    r = M.best_f1_grid(frame(spark, [0, 1], [0.2, 0.7])).first()
    assert (r["threshold"], r["f1"]) == (pytest.approx(0.21), 1.0)
    r = M.best_f1_grid(frame(spark, [0, 0], [0.2, 0.7])).first()
    assert (r["threshold"], r["f1"]) == (0.5, 0.0)
    # a score on a grid value reaches its threshold
    r = M.best_f1_grid(frame(spark, [0, 1], [0.35, 0.36])).first()
    assert r["threshold"] == pytest.approx(0.36)


def test_grid_matches_brute_force(spark, data):
    y, p = data
    best, at = 0.0, 0.5
    for t in range(10, 90):
        hit = p >= t / 100 - 1e-12
        tp = (hit & (y == 1)).sum()
        f = 2 * tp / (hit.sum() + y.sum())
        if f > best:
            best, at = f, t / 100
    r = M.best_f1_grid(frame(spark, y, p)).first()
    assert (r["threshold"], r["f1"]) == (pytest.approx(at), pytest.approx(best))


def test_ece_edges(spark):
    df = frame(spark, [1, 0], [0.0, 1.0])
    # 0 lies in no right-closed bin, so only the row at 1 counts
    assert M.ece_right_closed(df).first()["ece"] == pytest.approx(0.5)
    assert M.ece_left_closed(df).first()["ece"] == pytest.approx(1.0)


def test_all_metrics_agree_with_the_single_ones(spark, data):
    y, p = data
    df = frame(spark, y, p).unionByName(frame(spark, y, 1 - p, "n"))
    for r in M.all_metrics(df).collect():
        only = df.filter(F.col("model") == r["model"])
        c = M.score_counts(only)
        assert r["roc_auc"] == pytest.approx(M.roc_auc(c, ["model"]).first()["roc_auc"])
        b = M.basic_metrics(only).first()
        assert (r["accuracy"], r["f1"], r["brier"]) == pytest.approx((b["accuracy"], b["f1"], b["brier"]))
        assert r["ece"] == pytest.approx(M.ece_right_closed(only).first()["ece"])
        at = {x["min_recall"]: x for x in M.f1_at_recall(c, ["model"]).collect()}
        assert r["f1_recall_08"] == pytest.approx(at[0.8]["f1"])
        assert r["threshold_recall_09"] == pytest.approx(at[0.9]["threshold"])


def test_recall_bound_prefers_lowest_threshold(spark):
    c = M.score_counts(frame(spark, [1, 0, 1], [0.9, 0.5, 0.1]))
    r = M.f1_at_recall(c, ["model"], [0.8]).first()
    assert r["threshold"] == pytest.approx(0.1) and r["f1"] == pytest.approx(0.8)


def test_confusion_zero_denominators(spark):
    r = M.confusion_matrix(frame(spark, [0, 0], [0.1, 0.2])).first()
    assert (r["tn"], r["precision"], r["recall"], r["f1"]) == (2, 0.0, 0.0, 0.0)


def test_pairing_is_by_key_and_outcome(spark):
    a = frame(spark, [1, 0, 1], [0.1, 0.2, 0.3])
    b = frame(spark, [1, 1, 1], [0.4, 0.5, 0.6])
    assert {r["id"]: (r["p_a"], r["p_b"]) for r in M.pair_predictions(a, b).collect()} == {0: (0.1, 0.4), 2: (0.3, 0.6)}


def test_fold_ensemble_wants_every_fold(spark):
    df = spark.createDataFrame([("m", 1, 1, 0.2), ("m", 1, 1, 0.4), ("m", 2, 0, 0.1)],
                               "model string, id long, y_true int, y_pred double")
    out = {r["id"]: r["y_pred"] for r in M.fold_ensemble(df).collect()}
    assert out[1] == pytest.approx(0.3)
    with pytest.raises(Exception, match="unexpected fold count"):
        M.fold_ensemble(df, folds=2).collect()


def test_best_fold_takes_the_first_on_ties(spark):
    df = spark.createDataFrame([("m", 0, 0.5), ("m", 1, 0.7), ("m", 2, 0.7), ("m", 3, None)],
                               "model string, fold int, pr_auc double")
    assert M.select_best_fold(df).first()["selected_fold"] == 1


def test_parameter_aggregation(spark):
    rows = [("m", f, "depth", float(v), None) for f, v in enumerate([5, 8, 7])]
    rows += [("m", f, "kind", None, v) for f, v in enumerate(["b", "a", "a"])]
    df = spark.createDataFrame(rows, "model string, fold int, param string, number double, text string")
    got = {r["param"]: (r["number_value"], r["text_value"]) for r in M.aggregate_params(df).collect()}
    assert got == {"depth": (7.0, None), "kind": (None, "a")}


def test_bootstrap_interval_brackets_the_point_estimate(spark, data):
    y, p = data
    df = spark.createDataFrame([(i, int(a), float(b), float(1 - b)) for i, (a, b) in enumerate(zip(y, p))],
                               "id long, y_true int, p_a double, p_b double")
    r = M.bootstrap_ap_ci(df, n_boot=40).first()
    assert r["ap_a_low"] < brute_ap(y, p) < r["ap_a_high"]
    assert r["diff_low"] > 0
