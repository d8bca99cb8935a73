"""Profiling, cleaning and derived columns on hand-sized frames."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabsight.operators import cleaning as C
from tabsight.operators import derive as D
from tabsight.operators import profiling as P


def rows(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


def test_outlier_masks_edge_cases(spark):
    df = spark.createDataFrame([(float(v), 1.0, None) for v in [1, 2, 3, 4, 100]] + [(float("nan"), 1.0, None)],
                               "x double, same double, none double")
    z = P.outlier_zscore(df, ["x", "same", "none"], z=1.5).collect()
    assert [r["x_outlier"] for r in z] == [False, False, False, False, True, False]
    assert not any(r["same_outlier"] or r["none_outlier"] for r in z)
    q = P.outlier_iqr(df, ["x", "same", "none"]).collect()
    assert [r["x_outlier"] for r in q] == [False, False, False, False, True, False]
    assert not any(r["same_outlier"] or r["none_outlier"] for r in q)
    few = df.limit(3)
    assert not any(r["x_outlier"] for r in P.outlier_iqr(few, ["x"], k=0.0).collect())


def test_duplicates_flag_every_copy_and_match_nulls(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "a"), (1, "b")], "a int, b string")
    got = sorted((r["a"], r["b"] or "", r["flag_duplicate"]) for r in P.duplicate_flag(df).collect())
    assert got == [(1, "", True), (1, "", True), (1, "b", False), (2, "a", False)]
    assert P.dedupe_rows(df).count() == 3


def test_quality_flags_and_counts(spark):
    df = P.duplicate_flag(spark.createDataFrame([(120, 80), (70, 90), (300, 80), (-5, 20)], "hi int, lo int"))
    flagged = P.quality_flags(df, "hi", "lo")
    counts = dict(rows(P.quality_counts(flagged), "issue", "n"))
    assert counts == {"flag_low_gt_high": 2, "flag_high_extreme": 1, "flag_low_extreme": 1, "flag_high_negative": 1,
                      "flag_low_negative": 0, "flag_duplicate": 0}
    assert P.flagged_records(flagged).count() == 3


def test_sanity_filters(spark):
    df = spark.createDataFrame([(120, 80), (80, 80), (300, 80), (70, 90)], "hi int, lo int")
    assert rows(P.filter_sanity(df, "hi", "lo", strict=True), "hi") == [(120,)]
    assert sorted(rows(P.filter_sanity(df, "hi", "lo"), "hi")) == [(120,), (300,)]


def test_binned_rate_is_right_closed(spark):
    df = spark.createDataFrame([(5.0, 1), (10.0, 0), (10.1, 1), (4.0, 1), (99.0, 1)], "x double, y int")
    got = {r["bin"]: (r["n"], r["rate"], r["lower"], r["upper"]) for r in
           P.binned_target_rate(df, {"x": [4, 10, 20]}, "y").collect()}
    assert got == {0: (2, 0.5, 4.0, 10.0), 1: (1, 1.0, 10.0, 20.0)}


def test_missing_combination_counts_zero(spark):
    df = spark.createDataFrame([(1, 0), (1, 0), (2, 1), (3, 7)], "v int, y int")
    assert sorted(rows(P.count_by_value_class(df, "v", "y"), "value", "class", "n")) == [
        (1, 0, 2), (1, 1, 0), (2, 0, 0), (2, 1, 1)]


def test_poly_trend_equals_polyfit(spark):
    counts = [3, 9, 4, 12, 20, 18, 2, 1]
    df = spark.createDataFrame([(v, 1) for v, n in enumerate(counts) for _ in range(n)] + [(3, 0)], "v int, y int")
    want = np.clip(np.polyval(np.polyfit(range(8), counts, 5), range(8)), 0, None)
    got = [r["trend"] for r in P.poly_trend(df, "v", "y").orderBy("position").collect()]
    assert got == pytest.approx(list(want), abs=1e-6)


def test_domain_repair(spark):
    df = spark.createDataFrame([(1, 0), (1, 1), (2, 1), (9, 1), (2, 5)], "g int, y int")
    assert sorted(rows(P.domain_repair(df, "g", [1, 2], "y"), "g", "y")) == [(1, 0), (1, 1), (1, 1), (2, 1)]


def test_class_balance_and_report(spark):
    df = spark.createDataFrame([(0,), (0,), (0,), (1,)], "y int")
    got = {r["class"]: (r["n"], r["share"], r["imbalanced"], r["outside_band"]) for r in P.class_balance(df, "y").collect()}
    assert got == {0: (3, 0.75, True, True), 1: (1, 0.25, True, True)}
    t = spark.createDataFrame([(120, 80, 1, 170.0), (70, 90, 0, None), (70, 90, 0, None)],
                              "hi int, lo int, y int, h double")
    rep = {(r["category"], r["feature"]): r["n"] for r in P.quality_report(
        t, high="hi", low="lo", max_high=240, min_low=40, ranges={"h": (100, 160)}, target="y").collect()}
    assert rep == {("data_fix", "lo>hi"): 2, ("missing", "*"): 2, ("outlier", "h"): 1,
                   ("class_imbalance", "y"): 1, ("duplicate", "*"): 1}


def test_pair_repair_steps(spark):
    df = spark.createDataFrame([(1, 120, 80), (2, 80, 120), (3, -1, 70), (4, 300, 10), (5, 95, 95), (6, 130, 90)],
                               "id int, hi int, lo int")
    got = {r["id"]: (r["hi"], r["lo"]) for r in C.pair_repair(df, "hi", "lo").collect()}
    # differences of sound rows: 40, 40, 180, 40 -> median 40
    assert got == {1: (120, 80), 2: (120, 80), 4: (240, 60), 5: (135, 95), 6: (130, 90)}


def test_pair_repair_falls_back_to_a_default(spark):
    df = spark.createDataFrame([(100, 100)], "hi int, lo int")
    assert rows(C.pair_repair(df, "hi", "lo"), "hi", "lo") == [(140.0, 100.0)]
    kept = C.pair_repair(spark.createDataFrame([(0, -3)], "hi int, lo int"), "hi", "lo", drop_negative=False, cap=False)
    assert rows(kept, "hi", "lo") == [(90.0, 60.0)]


def test_winsorize_variants(spark):
    df = spark.createDataFrame([(v,) for v in [0.0, 5.0, 50.0, 500.0, None]], "x double")
    assert [r[0] for r in C.winsorize_fixed(df, {"x": (10, 100)}, ["x"]).collect()] == [0.0, 10.0, 50.0, 100.0, None]
    assert [r[0] for r in C.winsorize_masked(df, {"x": (10, 100)}, {"x": F.col("x") > 60}).collect()] == [
        0.0, 5.0, 50.0, 100.0, None]


def test_imputation(spark):
    df = spark.createDataFrame([(1.0, "b", None), (3.0, "a", None), (None, None, None)], "x double, c string, e double")
    assert [r[0] for r in C.impute_median(df, ["x", "e"]).select("x").collect()] == [1.0, 3.0, 2.0]
    assert [r[0] for r in C.impute_median(df, ["e"]).select("e").collect()] == [0.0] * 3
    assert [r[0] for r in C.impute_mode(df, ["c"]).select("c").collect()] == ["b", "a", "a"]
    none = spark.createDataFrame([(None,)], "c string")
    assert C.impute_mode(none, ["c"]).first()[0] == "unknown"


def test_iterative_imputation_recovers_a_line(spark):
    data = [(float(i), 2.0 * i + 1 if i % 5 else None) for i in range(60)]
    got = C.impute_iterative(spark.createDataFrame(data, "a double, b double"), ["a", "b"]).collect()
    assert all(r["b"] == pytest.approx(2 * r["a"] + 1, abs=1e-3) for r in got)


def test_standardize_onehot(spark):
    df = spark.createDataFrame([(1, 1.0, "x"), (2, 3.0, "y"), (3, None, None)], "id int, v double, c string")
    got = C.standardize_onehot(df, ["v"], ["c"]).collect()
    assert [r["c__x"] for r in got] == [1, 0, 1] and [r["c__y"] for r in got] == [0, 1, 0]
    assert sum(r["v"] for r in got) == pytest.approx(0) and got[2]["v"] == pytest.approx(0)


def test_units_and_buckets(spark):
    days = spark.createDataFrame([(10798,), (18250,)], "age int")
    assert rows(D.unit_convert(days, "age", "years"), "years") == [(29,), (50,)]
    years = spark.createDataFrame([(29,), (30,), (0,), (200,)], "age int")
    assert rows(D.unit_convert(years, "age", "years"), "years") == [(29,), (30,), (0,), (200,)]
    assert rows(D.bucket_fixed(years, "age", "g"), "g") == [(0,), (1,), (0,), (4,)]


def test_body_mass_edge(spark):
    df = spark.createDataFrame([(25.0, 100.0), (80.0, 0.0)], "w double, h double")
    got = D.bucket_fixed(D.guarded_ratio(df, "w", "h", "bmi"), "bmi", "g", D.RATIO_EDGES).collect()
    assert got[0]["bmi"] == pytest.approx(25.0) and got[0]["g"] == 1 and got[1]["bmi"] is None and got[1]["g"] is None


@pytest.mark.parametrize("hi,lo,want", [(110, 70, 0), (125, 70, 1), (125, 85, 2), (135, 70, 2), (150, 70, 3),
                                        (110, 95, 3), (185, 70, 4), (100, 120, 4), (None, None, 0)])
def test_stages_last_rule_wins(spark, hi, lo, want):
    df = spark.createDataFrame([(hi, lo)], "hi int, lo int")
    assert D.stage_rules(df, "hi", "lo", "s").first()["s"] == want


def test_flags_bands_and_scores(spark):
    df = spark.createDataFrame([(2, None, 1), (1, 25.0, None), (None, 24.9, 0)], "c int, r double, s int")
    assert rows(D.threshold_flags(df, {"c": 1}, {"r": 25}), "c_high", "r_flag") == [(1, 0), (0, 1), (0, 0)]
    assert rows(D.level_recode(df, "c", "k"), "k") == [(1,), (0,), (0,)]
    assert rows(D.composite_score(df, {"s": 1.0, "c": -0.5, "gone": 9}, "t"), "t") == [(0.0,), (-0.5,), (0.0,)]
    band = spark.createDataFrame([(-0.5,), (-0.25,), (0.0,), (0.5,), (0.51,), (None,)], "x double")
    assert [r["b"] for r in D.score_band(band, "x", "b").collect()] == [
        "Very Good", "Good", "Medium", "Medium", "Bad", None]
    assert band.select(D.display_name(F.lit("num__a__b")).alias("n")).first()["n"] == "a__b"


def test_guarded_diff_and_products(spark):
    df = spark.createDataFrame([(120, 80), (80, 80), (0, -1)], "hi int, lo int")
    assert rows(D.guarded_diff(df, "hi", "lo", "d"), "d") == [(40,), (None,), (None,)]
    out = D.interactions(df, {"p": ("hi", "lo"), "q": ("hi", "none")})
    assert out.columns == ["hi", "lo", "p"]


def test_missing_readings_raise_no_flag_and_are_not_filled(spark):
    df = spark.createDataFrame([(1, 120.0, 80.0), (2, None, 80.0), (3, 120.0, None), (4, 70.0, 90.0)], "id int, hi double, lo double")
    kept = {mode: {r["id"] for r in P.filter_sanity(df, "hi", "lo", strict=mode).collect()} for mode in (False, True)}
    assert kept[False] == {1, 2, 3} and kept[True] <= kept[False] and {2, 3} <= kept[True]
    assert {r["id"]: r["flag_low_gt_high"] for r in P.quality_flags(df, "hi", "lo").collect()} == {1: False, 2: False, 3: False, 4: True}
    fixed = {r["id"]: (r["hi"], r["lo"]) for r in C.pair_repair(df, "hi", "lo", drop_negative=False).collect()}
    assert fixed[2] == (None, 80.0) and fixed[3] == (120.0, None) and fixed[4] == (90.0, 70.0)


def test_histogram_and_quartiles_keep_a_null_class(spark):
    df = spark.createDataFrame([(None if i % 4 == 0 else i % 2, float(i)) for i in range(80)], "y int, x double")
    assert sum(r["n"] for r in P.class_histogram(df, "x", "y").collect()) == 80
    assert {r["y"]: r["n"] for r in P.class_quartiles(df, ["x"], "y").collect()} == {None: 20, 0: 20, 1: 40}


@pytest.mark.parametrize("tracked", [10_000, 100])
def test_most_frequent_by_sketch_and_by_count(spark, monkeypatch, tracked):
    monkeypatch.setattr(P, "TRACKED", tracked)
    df = spark.range(6000).select(
        F.when(F.col("id") % 5 == 0, "mode").otherwise(F.concat(F.lit("v"), "id")).alias("heavy"),
        F.concat(F.lit("u"), 10_000 - F.col("id")).alias("unique.key"), (F.col("id") % 4).alias("tied"), (F.col("id") % 20).alias("twenty"),
        F.lit(None).cast("string").alias("none"), (F.col("id") % 3).cast("double").alias("float"), (F.col("id") % 2 == 0).alias("flag"),
        F.when(F.col("id") % 9 > 0, F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 9).cast("int"))).alias("day"))
    want = {"heavy": "mode", "unique.key": "u10000", "tied": 0, "twenty": 0, "none": None, "float": 0.0, "flag": False, "day": datetime.date(2024, 1, 2)}
    assert P.most_frequent(df.repartition(7), df.columns) == want
    assert P.most_frequent(df.limit(0), df.columns) == dict.fromkeys(df.columns) and P.most_frequent(df, []) == {}
