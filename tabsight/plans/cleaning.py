"""Cleaning queries."""

from __future__ import annotations

from tabsight.operators import cleaning as C
from tabsight.plans.registry import query
from tabsight.plans.views import (MEASURE, MEASURE_DUP, MEASURE_KEYS, MEASURE_NULL, MEASURE_SIGNED, measure,
                                  measure_dup, measure_null, measure_signed, with_views)
from pyspark.sql import functions as F

KEYS = ", ".join(MEASURE_KEYS)
HIGH, LOW = (2, 9), (1, 6)


def sql_repair(src: str) -> str:
    """The repaired pair as a CTE ``rep`` over a source with integer hi and lo."""
    return f"""r1 AS (SELECT * REPLACE (greatest(hi, lo) AS hi, least(hi, lo) AS lo) FROM {src} WHERE hi>=0 AND lo>=0),
r2 AS (SELECT * REPLACE (least(greatest(hi, 2), 9) AS hi, least(greatest(lo, 1), 6) AS lo) FROM r1),
g AS (SELECT coalesce(quantile_cont((hi-lo)::double, 0.5), 40.0) AS gap FROM r2 WHERE hi>lo AND hi>=2 AND lo>=1),
rep AS (SELECT r2.* REPLACE ((CASE WHEN hi=lo THEN lo+gap ELSE hi END)::double AS hi, lo::double AS lo) FROM r2, g)"""


@query("pair_repair", with_views(MEASURE_SIGNED, sql_repair("v_signed")) + f"SELECT {KEYS}, hi, lo FROM rep")
def pair_repair(spark, sf_dir):
    m = measure_signed(spark, sf_dir).select(*MEASURE_KEYS, "hi", "lo")
    return C.pair_repair(m, "hi", "lo", high_range=HIGH, low_range=LOW)


@query("winsorize_fixed", with_views(MEASURE_SIGNED) + f"""
SELECT {KEYS}, least(greatest(l_quantity, 5), 45)::double AS l_quantity,
  (CASE WHEN hi<=0 THEN hi ELSE least(greatest(hi, 2), 8) END)::double AS hi FROM v_signed""")
def winsorize_fixed(spark, sf_dir):
    m = measure_signed(spark, sf_dir).select(*MEASURE_KEYS, "l_quantity", "hi")
    return C.winsorize_fixed(m, {"l_quantity": (5, 45), "hi": (2, 8)}, positive_only=["hi"])


@query("winsorize_masked", with_views(MEASURE) + f"""
SELECT {KEYS}, CASE WHEN l_quantity<a-0.4*(b-a) OR l_quantity>b+0.4*(b-a) THEN least(greatest(l_quantity, 6), 44)
  ELSE l_quantity END::double AS l_quantity FROM v_measure,
  (SELECT quantile_cont(l_quantity, 0.25) a, quantile_cont(l_quantity, 0.75) b FROM v_measure)""")
def winsorize_masked(spark, sf_dir):
    m = measure(spark, sf_dir).select(*MEASURE_KEYS, "l_quantity")
    return C.winsorize_masked_iqr(m, {"l_quantity": (6, 44)}, k=0.4)


@query("winsorize_pct", with_views(MEASURE) + f"""
SELECT {KEYS}, round(least(greatest(l_extendedprice, a), b), 6) AS l_extendedprice, least(greatest(l_quantity, c), d)
  AS l_quantity FROM v_measure, (SELECT quantile_cont(l_extendedprice, 0.01) a, quantile_cont(l_extendedprice, 0.99) b,
  quantile_cont(l_quantity, 0.01) c, quantile_cont(l_quantity, 0.99) d FROM v_measure)""")
def winsorize_pct(spark, sf_dir):
    m = measure(spark, sf_dir).select(*MEASURE_KEYS, "l_extendedprice", "l_quantity")
    return C.winsorize_pct(m, ["l_extendedprice", "l_quantity"])


@query("impute_median", with_views(MEASURE_NULL) + f"""
SELECT {KEYS}, coalesce(l_quantity, (SELECT quantile_cont(l_quantity, 0.5) FROM v_null)) AS l_quantity FROM v_null""")
def impute_median(spark, sf_dir):
    m = measure_null(spark, sf_dir).select(*MEASURE_KEYS, "l_quantity")
    return C.impute_median(m, ["l_quantity"])


SQL_MODE = """(SELECT l_linestatus FROM v_null WHERE l_linestatus IS NOT NULL GROUP BY 1
  ORDER BY count(*) DESC, l_linestatus LIMIT 1)"""


@query("impute_mode", with_views(MEASURE_NULL) + f"""
SELECT {KEYS}, coalesce(l_linestatus, {SQL_MODE}) AS l_linestatus FROM v_null""")
def impute_mode(spark, sf_dir):
    m = measure_null(spark, sf_dir).select(*MEASURE_KEYS, "l_linestatus")
    return C.impute_mode(m, ["l_linestatus"])


@query("impute_iterative")
def impute_iterative(spark, sf_dir):
    m = measure_null(spark, sf_dir).select(
        *MEASURE_KEYS, "l_quantity", F.when(F.col("l_suppkey") % 19 != 0, F.col("l_extendedprice"))
        .alias("l_extendedprice"), F.col("hi").cast("double").alias("hi"))
    return C.impute_iterative(m, ["l_quantity", "l_extendedprice", "hi"])


@query("standardize_onehot", with_views(MEASURE_NULL) + f""",
f AS (SELECT {KEYS}, coalesce(l_quantity, (SELECT quantile_cont(l_quantity, 0.5) FROM v_null)) AS l_quantity,
  l_extendedprice, coalesce(l_linestatus, {SQL_MODE}) AS s FROM v_null),
t AS (SELECT avg(l_quantity) mq, stddev_pop(l_quantity) sq, avg(l_extendedprice) mp, stddev_pop(l_extendedprice) sp FROM f)
SELECT {KEYS}, round((l_quantity-mq)/sq, 6) AS l_quantity, round((l_extendedprice-mp)/sp, 6) AS l_extendedprice,
  (s='F')::int AS "l_linestatus__F", (s='O')::int AS "l_linestatus__O" FROM f, t""")
def standardize_onehot(spark, sf_dir):
    m = measure_null(spark, sf_dir).select(*MEASURE_KEYS, "l_quantity", "l_extendedprice", "l_linestatus")
    return C.standardize_onehot(m, ["l_quantity", "l_extendedprice"], ["l_linestatus"])


CLEAN = dict(high="hi", low="lo", high_range=HIGH, low_range=LOW, caps={"l_quantity": (5, 45)},
             numeric=["l_quantity"], categorical=["l_linestatus"])


def dirty(spark, sf_dir):
    """Rows with missing values, negatives and copies."""
    m = measure_dup(spark, sf_dir).withColumn("hi", F.col("hi") - 1)
    return m.withColumns({
        "l_quantity": F.when(F.col("l_orderkey") % 17 != 0, F.col("l_quantity")),
        "l_linestatus": F.when(F.col("l_partkey") % 13 != 0, F.col("l_linestatus"))})


SQL_CLEAN = MEASURE_DUP + """, dirty AS (SELECT * REPLACE (hi-1 AS hi,
  CASE WHEN l_orderkey%17<>0 THEN l_quantity END AS l_quantity,
  CASE WHEN l_partkey%13<>0 THEN l_linestatus END AS l_linestatus) FROM v_dup),
uniq AS (SELECT DISTINCT * FROM dirty),
""" + sql_repair("uniq") + """,
cap AS (SELECT * REPLACE (CASE WHEN l_quantity IS NOT NULL THEN least(greatest(l_quantity, 5), 45) END AS l_quantity)
  FROM rep),
cleaned AS (SELECT * REPLACE (coalesce(l_quantity, (SELECT quantile_cont(l_quantity, 0.5) FROM cap))::double AS l_quantity,
  coalesce(l_linestatus, (SELECT l_linestatus FROM cap WHERE l_linestatus IS NOT NULL GROUP BY 1
    ORDER BY count(*) DESC, l_linestatus LIMIT 1)) AS l_linestatus) FROM cap)
"""


@query("cleaned_table", with_views(SQL_CLEAN) + "SELECT * FROM cleaned")
def cleaned_table(spark, sf_dir):
    return C.clean_table(dirty(spark, sf_dir), **CLEAN)


@query("clean_metadata", with_views(SQL_CLEAN) + """
SELECT a AS initial_count, b AS final_count, a-b AS removed, 10 AS columns, m AS missing_after, p AS positive_ratio
FROM (SELECT count(*) AS a FROM dirty), (SELECT count(*) AS b, 0::bigint AS m, round(avg(target), 6) AS p FROM cleaned)""")
def clean_metadata(spark, sf_dir):
    d = dirty(spark, sf_dir)
    return C.clean_metadata(d, C.clean_table(d, **CLEAN), "target")
