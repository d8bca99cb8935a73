"""Exact quantiles, running totals, hash positions: the pieces everything ranked rests on."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabsight.operators.metrics import all_metrics, average_precision, roc_auc, score_counts
from tabsight.operators.quantiles import exact_quantiles, quantile_values
from tabsight.operators.ranking import range_cells, running_totals
from tabsight.operators.splits import bootstrap_weights, hash_positions, poisson_cuts, stratified_folds, stratified_split

PROBS = [0.0, 0.01, 0.25, 0.5, 0.8, 0.99, 1.0]


@pytest.mark.parametrize("accuracy", [30, 100, 20_000])
@pytest.mark.parametrize("kind", ["normal", "tied", "skewed"])
def test_quantiles_match_numpy(spark, accuracy, kind):
    rng = np.random.default_rng(1)
    n = 4001
    x = {"normal": rng.normal(size=n), "tied": rng.integers(0, 5, n).astype(float),
         "skewed": np.where(rng.random(n) < 0.4, 7.0, rng.exponential(50, n))}[kind]
    df = spark.createDataFrame([(float(v), float(-v)) for v in x], "a double, b double").repartition(5)
    got = quantile_values(df, ["a", "b"], PROBS, accuracy=accuracy)
    assert got["a"] == pytest.approx(list(np.percentile(x, [100 * p for p in PROBS])))
    assert got["b"] == pytest.approx(list(np.percentile(-x, [100 * p for p in PROBS])))


@pytest.mark.parametrize("accuracy", [40, 20_000])
def test_quantiles_by_group_ignore_missing(spark, accuracy):
    rng = np.random.default_rng(2)
    rows = [(g, float(v)) for g in ("a", "b") for v in rng.normal(size=900) * (1 if g == "a" else 100)]
    df = spark.createDataFrame(rows + [("a", None), ("a", float("nan")), ("b", float("inf")), ("c", None)],
                               "g string, x double")
    got = {r["g"]: (r["n"], list(r["q"])) for r in
           exact_quantiles(df, ["x"], [0.1, 0.5], by=["g"], accuracy=accuracy).collect()}
    for g in ("a", "b"):
        mine = [v for k, v in rows if k == g]
        assert got[g][0] == 900
        assert got[g][1] == pytest.approx(list(np.percentile(mine, [10, 50])))
    assert got["c"] == (0, [None, None])


def test_quantiles_cell_by_cell(spark):
    rng = np.random.default_rng(12)
    rows = [(g, float(v)) for g in ("a", "b") for v in np.round(rng.exponential(20, 1500), 1)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(4)
    for accuracy in (50, 20_000):
        got = {r["g"]: list(r["q"]) for r in exact_quantiles(df, ["x"], PROBS, by=["g"], accuracy=accuracy).collect()}
        for g in ("a", "b"):
            want = np.percentile([v for k, v in rows if k == g], [100 * p for p in PROBS])
            assert got[g] == pytest.approx(list(want))
        assert quantile_values(df, ["x"], PROBS, accuracy=accuracy)["x"] == pytest.approx(
            list(np.percentile([v for _, v in rows], [100 * p for p in PROBS])))


@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_quantiles_of_few_rows(spark, n):
    x = [3.0, 1.0, 10.0, 2.0][:n]
    df = spark.createDataFrame([(v,) for v in x], "x double")
    assert quantile_values(df, ["x"], [0.25, 0.5])["x"] == pytest.approx(list(np.percentile(x, [25, 50])))


@pytest.mark.parametrize("cells", [2, 16, 64])
@pytest.mark.parametrize("descending", [False, True])
def test_running_totals_match_a_plain_cumsum(spark, cells, descending):
    rng = np.random.default_rng(3)
    rows = sorted({(g, round(float(v), 2)) for g in ("a", "b") for v in rng.exponential(1, 400)})
    df = spark.createDataFrame([(g, v, i % 7) for i, (g, v) in enumerate(rows)], "g string, v double, m long")
    out = running_totals(df, by=["g"], value="v", sums={"m": "upto"}, descending=descending, cells=cells).collect()
    got = {(r["g"], r["v"]): r["upto"] for r in out}
    for g in ("a", "b"):
        mine = [(v, m) for (k, v), m in zip(rows, (i % 7 for i in range(len(rows)))) if k == g]
        total = 0
        for v, m in sorted(mine, reverse=descending):
            total += m
            assert got[(g, v)] == total


@pytest.mark.parametrize("bits", [2, 16])
def test_hash_positions_are_a_permutation_per_class(spark, bits):
    df = spark.range(2000).select(F.col("id").alias("k"), (F.col("id") % 3 == 0).cast("int").alias("y"))
    rows = hash_positions(df, ["y"], ["k"], "s", cell_bits=bits).collect()
    for y in (0, 1):
        mine = [r for r in rows if r["y"] == y]
        assert sorted(r["_rn"] for r in mine) == list(range(1, len(mine) + 1))
        assert {r["_n"] for r in mine} == {len(mine)}


def test_split_and_folds_are_stratified_and_stable(spark):
    df = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") < 300).cast("int").alias("y"))
    s = {r["k"]: r["split"] for r in stratified_split(df, "y", ["k"]).collect()}
    assert sum(s[k] == "test" for k in range(300)) == 60
    assert sum(s[k] == "test" for k in range(300, 1000)) == 140
    assert s == {r["k"]: r["split"] for r in stratified_split(df.repartition(7), "y", ["k"]).collect()}
    folds = stratified_folds(df, "y", ["k"], k=5).groupBy("y", "fold").count().collect()
    assert {r["count"] for r in folds if r["y"] == 1} == {60} and len(folds) == 10


def test_poisson_weights_have_the_right_mean(spark):
    cuts = poisson_cuts(1.0)
    assert cuts[0] / 2**32 == pytest.approx(np.exp(-1), abs=1e-6) and cuts == sorted(cuts)
    w = bootstrap_weights(spark.range(3000), ["id"], 10, rate=0.8).groupBy("replicate").agg(F.sum("w").alias("n"))
    totals = [r["n"] for r in w.collect()]
    assert len(totals) == 10 and abs(np.mean(totals) / 3000 - 0.8) < 0.03


def test_cells_are_even_whatever_the_ranges(spark):
    """One column in [0, 1] next to wide ones, and a score that nearly all rows share."""
    narrow = spark.range(20_000).select(F.lit("c0").alias("column"), F.rand(1).alias("value"))
    wide = spark.range(20_000).select(F.lit("c1").alias("column"), (F.rand(2) * 1e6).alias("value"))
    sizes = [r["count"] for r in range_cells(narrow.unionByName(wide), ["column", "value"], cells=16).groupBy("cell").count().collect()]
    assert len(sizes) > 12 and max(sizes) <= 2 * 40_000 / 16
    zeros = spark.range(50_000).select(F.when(F.col("id") % 100 < 97, 0.0).otherwise(F.rand(3)).alias("y_pred"), F.lit(1).alias("y_true"), F.lit("m").alias("model"))
    counts = score_counts(zeros)
    sizes = [r["count"] for r in range_cells(counts, ["model", "score"], cells=16).groupBy("cell").count().collect()]
    assert max(sizes) <= 2 * counts.count() / 16 + 1


def test_null_groups_are_kept(spark):
    df = spark.createDataFrame([(None if i % 10 == 0 else i % 2, i, float(i % 13) / 13, i % 3 == 0) for i in range(1000)], "y int, k long, p double, b boolean")
    assert stratified_split(df, "y", ["k"]).count() == 1000
    assert stratified_folds(df, "y", ["k"]).count() == 1000
    split = stratified_split(df, "y", ["k"]).filter("y IS NULL").groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in split} == {"test": 20, "train": 80}
    q = {r["y"]: (r["n"], r["q"]) for r in exact_quantiles(df, ["p"], [0.5], by=["y"]).collect()}
    mine = [float(i % 13) / 13 for i in range(0, 1000, 10)]
    assert q[None] == (100, [pytest.approx(float(np.median(mine)))])
    scored = df.select(F.col("y").alias("model"), F.col("b").cast("int").alias("y_true"), F.col("p").alias("y_pred"))
    counts = score_counts(scored)
    for found in (roc_auc(counts, ["model"]), average_precision(counts, ["model"]), all_metrics(scored)):
        assert {r["model"] for r in found.collect()} == {None, 0, 1}
    with pytest.raises(ValueError):
        poisson_cuts(800)
