import numpy as np
import pytest
from pyspark.sql import functions as F

from tabsight.operators import attribution as I


@pytest.fixture(scope="module")
def long(spark):
    rng = np.random.default_rng(8)
    rows = [(i, i % 3, f, s, float(rng.random())) for i in range(30) for f in ("x", "y") for s in range(2)]
    return spark.createDataFrame(rows, "id long, fold int, feature string, step int, score double")


@pytest.mark.parametrize("how", ["mean", "max", "sum"])
def test_matrix_and_long_forms_agree(long, how):
    nested = (long.groupBy("id", "feature").agg(F.array_sort(F.collect_list(F.struct("step", "score"))).alias("s"))
              .groupBy("id").agg(F.array_sort(F.collect_list(F.struct("feature", F.col("s.score").alias("v")))).alias("f"))
              .select("id", F.col("f.v").alias("matrix")))
    a = {(r["id"], r["feature"]): r["score"] for r in I.step_aggregate(long, how).collect()}
    b = {(r["id"], r["feature"]): r["score"] for r in I.step_aggregate_matrix(nested, "matrix", ["x", "y"], how).collect()}
    assert a == pytest.approx(b) and len(a) == 60


def test_global_moments_from_fold_moments(long):
    pdf = long.toPandas()
    got = {r["feature"]: r for r in I.attribution_global(long).filter("fold = 'global'").collect()}
    for f in ("x", "y"):
        v = pdf[pdf.feature == f].score
        assert got[f]["mean_score"] == pytest.approx(v.mean())
        assert got[f]["std_score"] == pytest.approx(v.std(ddof=0)) and got[f]["n_samples"] == 60


def test_compare_keeps_both_sides_and_family_ratio(spark):
    a = spark.createDataFrame([("x", 0.4), ("y", 0.6)], "feature string, mean_score double")
    b = spark.createDataFrame([("y", 0.3), ("z", 0.7)], "feature string, mean_score double")
    got = {r["feature"]: (r["a_mean"], r["b_mean"]) for r in I.importance_compare(a, b).collect()}
    assert got == {"x": (0.4, None), "y": (0.6, 0.3), "z": (None, 0.7)}
    fam = {r["feature"]: r for r in I.family_contribution(a, b, ["y", "z", "q"]).collect()}
    assert fam["y"]["ratio"] == pytest.approx(0.5) and fam["z"]["ratio"] == 0.0 and fam["q"]["ratio"] == 0.0
    assert fam["y"]["a_pct"] == pytest.approx(60) and fam["y"]["b_pct"] == pytest.approx(100)


def test_top_and_pivot(spark):
    df = spark.createDataFrame([("x", 0, 0.5), ("y", 0, 0.9), ("z", 1, 0.6)], "feature string, fold int, score double")
    piv = I.importance_pivot(df, [0, 1], 2).collect()
    assert [(r["feature"], r["fold_0"], r["fold_1"]) for r in piv] == [("y", 0.9, 0.0), ("x", 0.5, 0.0)]
    top = I.top_features(df.withColumnRenamed("score", "mean_score"), 1).first()
    assert (top["feature"], top["above_mean"]) == ("y", 1)


def test_cohort_means_use_labelled_ids_only(spark):
    scores = spark.createDataFrame([(1, "x", 1.0), (2, "x", 3.0), (3, "x", 9.0)], "id long, feature string, score double")
    cohorts = spark.createDataFrame([(1, "a", 0), (2, "a", 1)], "id long, c string, d int")
    got = {r["group"]: (r["mean_score"], r["n_samples"]) for r in I.attribution_by_cohort(scores, cohorts).collect()}
    assert got == {"c=a": (2.0, 2), "d=0": (1.0, 1), "d=1": (3.0, 1)}


def test_enrichment_and_details(spark):
    pred = spark.createDataFrame([(1, 1, 0.9), (2, 0, 0.2), (3, 1, 0.4)], "k long, y int, p double")
    parts = [spark.createDataFrame([(1, -0.5)], "k long, risk double"), spark.createDataFrame([(2, 0.7)], "k long, risk double")]
    e = I.enrich_predictions(pred, parts, "k")
    s = I.enrich_stats(e, ["risk"]).first()
    assert (s["rows"], s["matched"], s["missing_risk"]) == (3, 2, 1)
    d = I.detail_table(e, ["risk"], "risk", p="p", columns=["k", "y", "p", "risk"])
    assert [(r["k"], r["band"]) for r in d.collect()] == [(1, "Very Good"), (2, "Bad")]
    b = {r["band"]: (r["n"], r["accuracy"]) for r in I.band_stats(d, "band", y="y", p="p").collect()}
    assert b == {"Very Good": (1, 1.0), "Bad": (1, 1.0)}
    assert I.distribution_stats(e, "risk").first()["good"] == 1


def test_importance_summary(spark):
    df = spark.createDataFrame([(0, "x", 0.2), (1, "x", 0.4)], "fold int, feature string, importance double")
    rows = {(r["scope"], r["group"]): r for r in I.importance_summary(df).collect()}
    assert rows[("global", "all")]["mean_importance"] == pytest.approx(0.3)
    assert rows[("global", "all")]["std_importance"] == pytest.approx(np.std([0.2, 0.4], ddof=1))
    assert rows[("fold", "fold_1")]["mean_importance"] == 0.4
