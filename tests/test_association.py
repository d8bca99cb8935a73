import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabsight.operators import association as A


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(5)
    n = 800
    a = rng.normal(size=n)
    pdf = pd.DataFrame({"k": range(n), "a": a, "b": np.round(a + rng.normal(scale=0.1, size=n), 1),
                        "c": rng.integers(0, 3, n).astype(float), "f": (a > 0).astype(int), "g": (a > 0.01).astype(int),
                        "same": 1.0})
    pdf["y"] = ((a + rng.normal(size=n)) > 0).astype(int)
    return spark.createDataFrame(pdf), pdf


COLS = ["a", "b", "c", "f", "g"]


def matrix(df):
    return {(r["a"], r["b"]): r["r"] for r in df.collect()}


def test_correlations_match_pandas(table):
    df, pdf = table
    want = pdf[COLS].corr()
    got = matrix(A.corr_pearson(df, COLS))
    assert all(got[(i, j)] == pytest.approx(want.loc[i, j]) for i in COLS for j in COLS)
    want = pdf[COLS].rank().corr().abs()
    got = matrix(A.corr_spearman(df, COLS))
    assert all(got[(i, j)] == pytest.approx(want.loc[i, j]) for i in COLS for j in COLS)


def test_pearson_skips_incomplete_pairs(spark):
    pdf = pd.DataFrame({"a": [1.0, 2, 3, np.nan, 9], "b": [2.0, np.nan, 1, 4, np.inf]})
    got = matrix(A.corr_pearson(spark.createDataFrame(pdf), ["a", "b"]))
    assert got[("a", "b")] == pytest.approx(-1.0) and got[("a", "a")] == 1.0


def test_mutual_information_of_known_tables(spark):
    same = spark.createDataFrame([(i % 2, i % 2) for i in range(100)], "x int, y int")
    assert A.mutual_information(same, ["x"], "y").first()["mutual_info"] == pytest.approx(math.log(2))
    free = spark.createDataFrame([(i % 2, (i // 2) % 2) for i in range(100)], "x int, y int")
    assert A.mutual_information(free, ["x"], "y").first()["mutual_info"] == pytest.approx(0.0, abs=1e-12)


def test_audit_flags(table):
    df, _ = table
    got = {r["column"]: r for r in A.feature_audit(df, [*COLS, "same"], "y", drop=["g"]).collect()}
    assert got["same"]["constant"] and got["same"]["auc"] is None and not got["same"]["selected"]
    assert got["f"]["is_binary"] and got["f"]["near_constant"]
    assert got["a"]["selected"] and not got["a"]["is_binary"] and got["a"]["distinct"] == 800
    assert got["c"]["selected"] and not got["g"]["selected"]


def test_redundant_and_duplicate_features(table):
    df, pdf = table
    gone = {r["dropped"]: r["kept"] for r in A.redundant_features(df, COLS, "y").collect()}
    assert gone and not set(gone) & set(gone.values()) and set(gone) <= set(COLS)
    assert {r["column"] for r in A.binary_duplicates(df, COLS).collect()} == {"f", "g"}


def test_prune_prefers_the_listed_column(table):
    df, _ = table
    got = {r["dropped"] for r in A.prune_correlated(df, ["a", "b", "c"], "y", drop_first=["a"]).collect()}
    assert got == {"a"}
    info = df.sparkSession.createDataFrame([("a", 0.5), ("b", 0.1)], "column string, mutual_info double")
    assert {r["dropped"] for r in A.prune_correlated(df, ["a", "b"], "y", info=info).collect()} == {"b"}


@pytest.mark.parametrize("n", [5, 10, 11, 13, 100, 101])
def test_bins_equal_qcut_of_first_ranks(spark, n):
    x = [(i * 7) % 5 for i in range(n)]
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "k long, x double")
    got = A.quantile_bins(df, ["x"], ["k"]).toPandas()
    sizes = got["x"].value_counts().sort_index().tolist()
    assert sizes == pd.qcut(pd.Series(range(n)), 4, labels=False).value_counts().sort_index().tolist()
    joined = got.merge(pd.DataFrame({"k": range(n), "v": x}), on="k").sort_values("v")
    codes = joined["x"].str[-1].astype(int)
    assert all(codes[joined["v"] == a].max() <= codes[joined["v"] == b].min() or a == b
               for a in range(5) for b in range(a + 1, 5))


def test_bins_split_one_hot_value_at_the_right_row(spark):
    df = spark.range(1000).select(F.col("id").alias("k"), F.lit(3.0).alias("x"))
    got = [r["count"] for r in A.quantile_bins(df, ["x"], ["k"], names={"x": "n"}).groupBy("n").count().collect()]
    assert sorted(got) == [250, 250, 250, 250]


def test_shift_is_seen_only_where_it_is(spark):
    rng = np.random.default_rng(6)
    part = rng.integers(0, 2, 600)
    pdf = pd.DataFrame({"k": range(600), "moved": rng.normal(size=600) + 2.0 * part, "calm": rng.normal(size=600), "p": part})
    df = spark.createDataFrame(pdf)
    got = {r["column"]: r["severity"] for r in A.shift_univariate(df, ["moved", "calm"], "p").collect()}
    assert got["moved"] == "High" and got["calm"] in ("None", "Low")
    rf = A.shift_classifier(df, ["moved", "calm"], "p", ["k"], trees=5, depth=3).collect()
    top = max(rf, key=lambda r: r["importance"])
    assert top["column"] == "moved" and top["auc"] > 0.8


def brute_knn(x, y, k):
    """Mean over rows of the nearest-neighbour terms, all distances compared."""
    from math import log

    def psi(v):
        out = 0.0
        while v < 30:
            out -= 1 / v
            v += 1
        return out + log(v) - 1 / (2 * v) - 1 / (12 * v**2) + 1 / (120 * v**4)

    keep = np.array([(y == c).sum() > 1 for c in y])
    x, y = x[keep], y[keep]
    total = 0.0
    for i in range(len(x)):
        own = np.sort(np.abs(x[(y == y[i])] - x[i]))[1:]
        kk = min(k, len(own))
        d = own[kk - 1]
        inside = np.abs(x - x[i]) <= d * (1 - 1e-9)
        total += psi(kk) - psi((y == y[i]).sum()) - psi(inside.sum())
    return max(0.0, psi(len(x)) + total / len(x))


@pytest.mark.parametrize("k", [1, 3, 6])
def test_neighbour_information_against_brute_force(spark, k):
    rng = np.random.default_rng(6)
    n = 2000
    y = rng.integers(0, 3, n)
    y[:4] = [7, 8, 8, 9]  # single rows, and a class with fewer rows than neighbours
    cols = {"wide": y + rng.normal(size=n), "tied": np.round(y + 2 * rng.normal(size=n)), "noise": np.round(rng.random(n), 2), "one": np.zeros(n)}
    df = spark.createDataFrame(pd.DataFrame({**cols, "y": y}))
    got = {r["column"]: r["mutual_info"] for r in A.mutual_information_knn(df, list(cols), "y", k).collect()}
    assert got == pytest.approx({c: brute_knn(v, y, k) for c, v in cols.items()}, abs=1e-6)


@pytest.mark.parametrize("cells", [2, 40])
def test_neighbours_reach_over_cells(spark, cells):
    rng = np.random.default_rng(3)
    x = np.unique(np.round(rng.random(60), 3))
    m = rng.integers(1, 3, len(x))
    df = spark.createDataFrame([("g", float(v), int(c)) for v, c in zip(x, m)], "g string, value double, m long")
    got = {r["value"]: r["d"] for r in A.neighbour_distances(df, ["g"], 5, cells=cells).collect()}
    points = np.repeat(x, m)
    assert got == pytest.approx({v: np.sort(np.abs(points - v))[5] for v in x})


def test_correlation_with_gaps_is_pairwise_complete(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(700, 5)) @ rng.normal(size=(5, 5)) + 1e4
    x[:, 4] = 3.0
    x[rng.random(x.shape) < 0.2] = np.nan
    pdf = pd.DataFrame(x, columns=list("abcde"))
    got = {(r["a"], r["b"]): r["r"] for r in A.corr_pearson(spark.createDataFrame(pdf).repartition(5), list("abcde")).collect()}
    want = pdf.corr()
    assert len(got) == 25
    for (a, b), r in got.items():
        assert r == pytest.approx(want.loc[a, b], abs=1e-9) if a != b and "e" not in (a, b) else r == (1.0 if a == b else None)


@pytest.mark.parametrize("small", [10_000, 10, 0])
def test_rank_transform_by_lookup_and_by_cells(spark, table, monkeypatch, small):
    monkeypatch.setattr(A, "SMALL_ROWS", small)
    pdf = table[1][COLS].astype(float)
    pdf.loc[::7, "a"] = np.nan
    pdf.loc[3:5, :] = np.nan
    pdf["none"] = np.nan
    pdf["zero"] = np.where(np.arange(len(pdf)) % 2, 0.0, -0.0)
    got = A.rank_transform(spark.createDataFrame(pdf).repartition(5), list(pdf)).toPandas().astype(float)
    want = pdf.rank()
    order = list(pdf)
    pd.testing.assert_frame_equal(got.sort_values(order, ignore_index=True), want.sort_values(order, ignore_index=True))


def test_one_column_of_many_values_is_ranked_by_a_join_of_its_rows(spark, monkeypatch):
    """The rows need no numbers and no second shuffle then; NULLs stay."""
    monkeypatch.setattr(A, "SMALL_ROWS", 5)
    rows = [(None if k % 7 == 0 else float(k * k % 31), float(k % 3)) for k in range(60)]
    out = A.rank_transform(spark.createDataFrame(rows, "a double, b double"), ["a", "b"])
    assert "_row" not in out._jdf.queryExecution().optimizedPlan().toString()
    want = pd.DataFrame(rows, columns=["a", "b"]).rank()
    key = lambda r: tuple(-1.0 if v is None or v != v else v for v in r)
    assert sorted(map(key, out.collect())) == sorted(map(key, want.itertuples(index=False)))
