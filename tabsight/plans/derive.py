"""Derived-column queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsight.operators import derive as D
from tabsight.operators.profiling import target_rate_by_category
from tabsight.plans.cleaning import CLEAN, SQL_CLEAN, dirty
from tabsight.operators.cleaning import clean_table
from tabsight.plans.registry import query
from tabsight.plans.views import (MEASURE, MEASURE_KEYS, MEASURE_NULL, measure, measure_null, with_views)

KEYS = ", ".join(MEASURE_KEYS)


@query("unit_convert", with_views(MEASURE) + f"""
SELECT {KEYS}, CASE WHEN (SELECT avg(l_extendedprice) FROM v_measure)>120 THEN trunc(l_extendedprice/365.0::double)
  ELSE trunc(l_extendedprice) END::int AS price_units, CASE WHEN (SELECT avg(l_quantity) FROM v_measure)>120
  THEN trunc(l_quantity/365.0::double) ELSE trunc(l_quantity) END::int AS quantity_units FROM v_measure""")
def unit_convert(spark, sf_dir):
    m = measure(spark, sf_dir).select(*MEASURE_KEYS, "l_extendedprice", "l_quantity")
    return D.unit_convert(D.unit_convert(m, "l_extendedprice", "price_units"), "l_quantity", "quantity_units")


def sql_bucket(c: str, edges: list[float]) -> str:
    parts = [f"WHEN {c}>{'=' if i == 0 else ''}{a} AND {c}<={b} THEN {i}"
             for i, (a, b) in enumerate(zip(edges[:-1], edges[1:]))]
    return f"(CASE {' '.join(parts)} END)::int"


@query("bucket_fixed", with_views(MEASURE) + f"""
SELECT {KEYS}, {sql_bucket('l_quantity', [0, 18.5, 25, 30, 49])} AS quantity_group,
  {sql_bucket('hi', [0, 2, 5, 9])} AS hi_group FROM v_measure""")
def bucket_fixed(spark, sf_dir):
    m = D.bucket_fixed(measure(spark, sf_dir), "l_quantity", "quantity_group", [0, 18.5, 25, 30, 49])
    return D.bucket_fixed(m, "hi", "hi_group", [0, 2, 5, 9]).select(*MEASURE_KEYS, "quantity_group", "hi_group")


@query("guarded_ratio", with_views(MEASURE) + f"""
SELECT {KEYS}, round(CASE WHEN l_quantity>0 AND hi>0 THEN
  l_quantity/((hi/10.0::double)*(hi/10.0::double)+1e-9) END, 6) AS ratio FROM v_measure""")
def guarded_ratio(spark, sf_dir):
    return D.guarded_ratio(measure(spark, sf_dir), "l_quantity", "hi", "ratio", scale=10.0).select(*MEASURE_KEYS, "ratio")


@query("guarded_diff", with_views(MEASURE) + f"""
SELECT {KEYS}, CASE WHEN hi>0 AND lo>0 AND hi>lo THEN hi-lo END AS diff FROM v_measure""")
def guarded_diff(spark, sf_dir):
    return D.guarded_diff(measure(spark, sf_dir), "hi", "lo", "diff").select(*MEASURE_KEYS, "diff")


CUTS = {"high_cuts": (4, 5, 6, 9), "low_cuts": (3, 5, 7)}
SQL_STAGE = """(CASE WHEN hi>=9 OR lo>=7 THEN 4 WHEN (hi>=6 AND hi<9) OR (lo>=5 AND lo<7) THEN 3
  WHEN (hi>=5 AND hi<6) OR (lo>=3 AND lo<5) THEN 2 WHEN hi>=4 AND hi<5 AND lo<3 THEN 1 ELSE 0 END)::int"""


@query("stage_rules", with_views(MEASURE) + f"SELECT {KEYS}, hi, lo, {SQL_STAGE} AS stage FROM v_measure")
def stage_rules(spark, sf_dir):
    return D.stage_rules(measure(spark, sf_dir), "hi", "lo", "stage", **CUTS).select(
        *MEASURE_KEYS, "hi", "lo", "stage")


@query("threshold_flags", with_views(MEASURE_NULL) + f"""
SELECT {KEYS}, coalesce((hi>1)::int, 0) AS hi_high, coalesce((l_quantity>=25)::int, 0) AS l_quantity_flag FROM v_null""")
def threshold_flags(spark, sf_dir):
    return D.threshold_flags(measure_null(spark, sf_dir), {"hi": 1}, {"l_quantity": 25}).select(
        *MEASURE_KEYS, "hi_high", "l_quantity_flag")


@query("level_recode", with_views(MEASURE) + f"""
SELECT {KEYS}, CASE l_linenumber WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 2 ELSE 0 END AS code FROM v_measure""")
def level_recode(spark, sf_dir):
    return D.level_recode(measure(spark, sf_dir), "l_linenumber", "code").select(*MEASURE_KEYS, "code")


SQL_RISK = "round(coalesce(target, 0)*1.0 + coalesce((l_quantity>25)::int, 0)*0.5 - coalesce((hi>5)::int, 0)*0.5, 6)::double"


def _risk(m: DataFrame) -> DataFrame:
    m = m.withColumns({"large": (F.col("l_quantity") > 25).cast("int"), "active": (F.col("hi") > 5).cast("int")})
    return D.composite_score(m, {"target": 1.0, "large": 0.5, "active": -0.5, "absent": 3.0}, "risk")


@query("composite_score", with_views(MEASURE_NULL) + f"SELECT {KEYS}, {SQL_RISK} AS risk FROM v_null")
def composite_score(spark, sf_dir):
    return _risk(measure_null(spark, sf_dir)).select(*MEASURE_KEYS, "risk")


@query("score_band", with_views(MEASURE_NULL) + f"""
SELECT {KEYS}, risk, CASE WHEN risk<-0.25 THEN 'Very Good' WHEN risk<0 THEN 'Good' WHEN risk<=0.5 THEN 'Medium'
  ELSE 'Bad' END AS band FROM (SELECT {KEYS}, {SQL_RISK} AS risk FROM v_null)""")
def score_band(spark, sf_dir):
    return D.score_band(_risk(measure_null(spark, sf_dir)), "risk", "band").select(*MEASURE_KEYS, "risk", "band")


@query("interactions", with_views(MEASURE_NULL) + f"""
SELECT {KEYS}, round(l_quantity*hi, 6) AS quantity_hi, hi*lo AS hi_lo,
  regexp_replace('num__status__'||l_linestatus, '^.*?__', '') AS shown FROM v_null""")
def interactions(spark, sf_dir):
    m = D.interactions(measure_null(spark, sf_dir), {
        "quantity_hi": ("l_quantity", "hi"), "hi_lo": ("hi", "lo"), "none": ("hi", "absent")})
    return m.select(*MEASURE_KEYS, "quantity_hi", "hi_lo",
                    D.display_name(F.concat(F.lit("num__status__"), "l_linestatus")).alias("shown"))


def derived(spark, sf_dir) -> DataFrame:
    """Cleaned rows with the derived columns of the other queries in this module."""
    m = clean_table(dirty(spark, sf_dir), **CLEAN)
    m = D.stage_rules(m, "hi", "lo", "stage", **CUTS)
    m = D.bucket_fixed(m, "l_quantity", "quantity_group", [0, 18.5, 25, 30, 49])
    return D.threshold_flags(m, {"hi": 5})


@query("risk_by_derived_category", with_views(SQL_CLEAN) + f""",
d AS (SELECT {SQL_STAGE} AS stage, {sql_bucket('l_quantity', [0, 18.5, 25, 30, 49])} AS quantity_group,
  (hi>5)::int AS hi_high, l_linestatus, target FROM cleaned)
""" + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", cast({c} AS varchar) AS level, count(*) AS n, round(avg(target), 6) AS rate
    FROM d GROUP BY 2""" for c in ("stage", "quantity_group", "hi_high", "l_linestatus")))
def risk_by_derived_category(spark, sf_dir):
    """Flagship: clean, derive, then rate per category."""
    return target_rate_by_category(derived(spark, sf_dir), ["stage", "quantity_group", "hi_high", "l_linestatus"],
                                   "target")
