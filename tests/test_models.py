import inspect
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabsight.operators import association as A
from tabsight.operators import cleaning as C
from tabsight.operators import forest
from tabsight.operators import metrics as M
from tabsight.operators import models as T
from tabsight.operators.splits import fold_membership, oof_integrity, stratified_folds
from tabsight.plans.catalog import QUERIES
from tabsight.plans.views import predictions_long
from tests.compare import ROOT

QUICK = {"trees": 6, "depth": 4, "leaf": 2}
SMALL_SPACE = {"depth": (2, 4), "features": ("sqrt", "log2", 0.2, 1.0), "trees": (2, 6, 2), "leaf": (1, 5)}


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(9)
    n = 600
    x = rng.normal(size=(n, 3))
    y = (x[:, 0] + 0.5 * x[:, 1] + rng.normal(scale=0.7, size=n) > 0.6).astype(int)
    pdf = pd.DataFrame(x, columns=["u", "v", "w"]).assign(k=range(n), y=y)
    return spark.createDataFrame(pdf), pdf


def test_balanced_weights(table):
    df, pdf = table
    got = {r["y"]: r["weight"] for r in T.class_weights(df, "y").collect()}
    for c in (0, 1):
        assert got[c] == pytest.approx(600 / (2 * (pdf.y == c).sum()))
    assert T.with_class_weights(df, "y").agg(F.sum("weight")).first()[0] == pytest.approx(600)


def test_oof_is_complete_and_useful(table):
    df, _ = table
    oof = T.forest_oof(df, "y", ["k"], ["u", "v", "w"], k=3, params=[QUICK]).withColumnRenamed("k", "id")
    r = oof_integrity(oof, k=3).first()
    assert r["complete"] and r["rows"] == 600
    assert M.roc_auc(M.score_counts(oof), ["model"]).first()["roc_auc"] > 0.75


def test_fold_membership_is_a_partition(table):
    df, _ = table
    m = fold_membership(stratified_folds(df, "y", ["k"], k=4), ["k"], 4)
    parts = m.groupBy("k").agg(F.count_if(F.col("part") == "val").alias("v"), F.count("*").alias("n"))
    assert parts.filter("v <> 1 OR n <> 4").count() == 0


def test_platt_reaches_the_penalised_optimum(spark):
    rng = np.random.default_rng(10)
    p = np.round(rng.random(400), 2)
    y = (rng.random(400) < 0.2 + 0.5 * p).astype(int)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p)], "y_true int, y_pred double")
    fit = T.Platt.fit(df)
    a = b = 0.0
    for _ in range(50):  # Newton steps on log-loss + a^2 / 2
        q = 1 / (1 + np.exp(-(a * p + b)))
        g = np.array([((q - y) * p).sum() + a, (q - y).sum()])
        w = q * (1 - q)
        h = np.array([[(w * p * p).sum() + 1, (w * p).sum()], [(w * p).sum(), w.sum()]])
        a, b = np.array([a, b]) - np.linalg.solve(h, g)
    assert (fit.slope, fit.intercept) == pytest.approx((a, b), abs=1e-4)


def test_isotonic_is_monotone_and_pools(spark):
    df = spark.createDataFrame([(0, 0.1), (1, 0.2), (0, 0.3), (1, 0.8)], "y_true int, y_pred double")
    got = [r["y_pred"] for r in T.calibrate(df, "isotonic").collect()]
    assert sorted(got) == pytest.approx([0.0, 0.5, 0.5, 1.0])
    new = spark.createDataFrame([(1, 0.0), (1, 0.15), (1, 0.95)], "y_true int, y_pred double")
    assert [r["y_pred"] for r in T.calibrate(new, "isotonic", fit_on=df).collect()] == pytest.approx([0.0, 0.25, 1.0])


def test_isotonic_on_its_own_fold_has_no_error_left(spark):
    rng = np.random.default_rng(11)
    p = np.round(rng.random(300), 2)
    y = (rng.random(300) < p).astype(int)
    df = spark.createDataFrame([("m", i % 2, int(a), float(b)) for i, (a, b) in enumerate(zip(y, p))],
                               "model string, fold int, y_true int, y_pred double")
    for r in T.calibration_report(df, "isotonic", folds=[0, 1]).filter("fold >= 0").collect():
        assert r["ece_post"] == pytest.approx(0.0, abs=1e-9) and r["delta_brier"] < 0


def two_models(spark):
    rng = np.random.default_rng(12)
    rows = [(m, i % 3, int(rng.random() < (q if m == "a" else 1 - q)), float(q))
            for m in ("a", "b") for i, q in enumerate(np.round(rng.random(150), 2))]
    return spark.createDataFrame(rows, "model string, fold int, y_true int, y_pred double")


@pytest.mark.parametrize("method", ["platt", "isotonic"])
def test_cross_calibration_covers_every_model_and_fold(spark, method):
    df = two_models(spark)
    got = T.cross_calibrate(df, method)
    assert got.count() == df.count() == 300
    for m in ("a", "b"):
        for f in range(3):
            own = df.filter(F.col("model") == m)
            want = T.calibrate(own.filter(F.col("fold") == f), method, fit_on=own.filter(F.col("fold") != f))
            cell = got.filter((F.col("model") == m) & (F.col("fold") == f))
            assert sorted(r["y_pred"] for r in cell.collect()) == pytest.approx(sorted(r["y_pred"] for r in want.collect()))


def test_cross_calibration_needs_a_second_fold(spark):
    with pytest.raises(ValueError, match="single fold"):
        T.cross_calibrate(two_models(spark).filter("model = 'a' OR fold = 0"))


def test_calibration_report_fits_each_model_apart(spark):
    df = two_models(spark)
    both = {(r["model"], r["fold"]): r for r in T.calibration_report(df, "isotonic", folds=range(3)).collect()}
    for m in ("a", "b"):
        for r in T.calibration_report(df.filter(F.col("model") == m), "isotonic", folds=range(3)).collect():
            assert both[m, r["fold"]]["brier_post"] == pytest.approx(r["brier_post"])


@pytest.mark.skipif(not os.path.isdir(f"{ROOT}/sf0.001"), reason="no test tables")
def test_registered_platt_calibrates_all_predictions(spark):
    got = QUERIES["calibrate_platt"](spark, f"{ROOT}/sf0.001")
    want = predictions_long(spark, f"{ROOT}/sf0.001")
    assert got.select("id", "fold", "model", "y_true").exceptAll(want.select("id", "fold", "model", "y_true")).count() == 0
    assert got.count() == want.count()


def test_search_returns_every_trial_best_first(table):
    df, _ = table
    space = {"depth": (2, 4), "features": ("sqrt", "log2", 0.2, 1.0), "trees": (2, 6, 2), "leaf": (1, 5)}
    got = T.forest_search(df, "y", ["k"], ["u", "v", "w"], trials=3, k=2, space=space).collect()
    assert sorted(r["trial"] for r in got) == [0, 1, 2]
    assert [r["composite"] for r in got] == sorted((r["composite"] for r in got), reverse=True)
    assert T.sample_params(4, seed=1) == T.sample_params(4, seed=1)


def test_final_scoring_uses_a_frozen_threshold(table):
    df, _ = table
    r = T.final_scoring(df, "y", ["k"], ["u", "v", "w"], k=2, params=[QUICK, {**QUICK, "depth": 2}]).first()
    assert r["roc_auc"] > 0.7 and 0.1 <= r["threshold_deploy"] < 0.9 and r["f1_deploy"] <= r["f1_best"] + 1e-9
    assert r["selected_fold"] in (0, 1)


def roots_drawn(monkeypatch, run):
    """Weighted rows at the root of every tree that ``run`` grows, by the forest's number and left-out fold, for each call."""
    grown, grow = [], forest.grow
    monkeypatch.setattr(forest, "grow", lambda *args, **options: grown.append(grow(*args, **options)) or grown[-1])
    run().collect()
    monkeypatch.undo()
    out = []
    for one in grown:
        found = {}
        for r in one.nodes().filter("node = 0").collect():
            found.setdefault((r["forest"], r["fold"]), []).append(r["w0"] + r["w1"])
        out.append(found)
    return out


# What each operator trains on: whether fold by fold, and its share of the 600 rows.
TRAINING = {
    "forest_oof": (lambda df: T.forest_oof(df, "y", ["k"], ["u", "v", "w"], k=3, params=[QUICK]), [(3, 2 / 3)]),
    "forest_oof_metrics": (lambda df: M.all_metrics(T.forest_oof(df, "y", ["k"], ["u", "v", "w"], k=3, params=[QUICK]), by=["model", "fold"]), [(3, 2 / 3)]),
    "forest_attribution": (lambda df: T.forest_attribution(df, "y", ["k"], ["u", "v", "w"], params=QUICK), [(1, 1)]),
    "fold_ensemble_scoring": (lambda df: T.fold_ensemble_scoring(df, "y", ["k"], ["u", "v", "w"], k=3, params=QUICK), [(3, 0.8 * 2 / 3)]),
    "shift_classifier": (lambda df: A.shift_classifier(df, ["u", "v", "w"], "y", ["k"], trees=6, depth=4), [(1, 0.7)]),
    "final_scoring": (lambda df: T.final_scoring(df, "y", ["k"], ["u", "v", "w"], k=3, params=[QUICK]), [(3, 0.8 * 2 / 3), (1, 0.8)]),
    "forest_search": (lambda df: T.forest_search(df, "y", ["k"], ["u", "v", "w"], trials=3, k=3, space=SMALL_SPACE), [(3, 2 / 3)]),
}


@pytest.mark.parametrize("name", TRAINING)
def test_every_tree_draws_as_many_rows_as_there_are_to_train_on(table, monkeypatch, name):
    run, wanted = TRAINING[name]
    found = roots_drawn(monkeypatch, lambda: run(table[0]))
    assert len(found) == len(wanted)
    for roots, (forests, share) in zip(found, wanted, strict=True):
        assert len(roots) == forests
        for drawn in roots.values():  # weights move a draw's sum a little away from its rows
            assert drawn == pytest.approx([600 * share] * len(drawn), rel=0.25)


def test_row_attribution_sums_to_one_and_ranks_the_signal(table):
    df, _ = table
    a = T.row_attribution(df, "y", ["k"], ["u", "v", "w"])
    assert a.groupBy("k").agg(F.sum("score").alias("s")).filter("abs(s - 1) > 1e-9").count() == 0
    mean = {r["feature"]: r["m"] for r in a.groupBy("feature").agg(F.avg("score").alias("m")).collect()}
    assert mean["u"] > mean["v"] > mean["w"]


@pytest.mark.skipif(not os.path.isdir(f"{ROOT}/sf0.001"), reason="no test tables")
@pytest.mark.parametrize("module, name", [(T, "fold_ensemble_scoring"), (T, "forest_attribution"), (T, "forest_search"), (T, "forest_oof"), (T, "final_scoring"),
                                          (T, "forest_importance"), (C, "impute_iterative")])
def test_registered_queries_take_the_operators_defaults(spark, monkeypatch, module, name):
    signature, seen = inspect.signature(getattr(module, name)), {}

    def record(*args, **options):
        bound = signature.bind(*args, **options)
        bound.apply_defaults()
        seen.update(bound.arguments)
        raise InterruptedError

    monkeypatch.setattr(module, name, record)
    with pytest.raises(InterruptedError):
        QUERIES[name](spark, f"{ROOT}/sf0.001")
    for option, p in signature.parameters.items():
        if p.default is not p.empty:
            assert seen[option] == p.default, option
    assert seen.get("k", 5) == 5
