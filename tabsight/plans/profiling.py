"""Profiling and data-quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabsight.operators import profiling as P
from tabsight.operators.derive import two_state
from tabsight.plans.registry import query
from tabsight.plans.views import (MEASURE, MEASURE_DUP, MEASURE_KEYS, MEASURE_NULL, MEASURE_SIGNED, measure,
                                  measure_dup, measure_null, measure_signed, with_views)

KEYS = ", ".join(MEASURE_KEYS)
NUMERIC = ["l_quantity", "l_extendedprice", "hi", "lo", "l_linenumber"]


def _num_summary(c: str) -> str:
    return (f"SELECT '{c}' AS \"column\", count({c}) AS count, avg({c}) AS mean, stddev_samp({c}) AS std, "
            f"min({c})::double AS min, quantile_cont({c}, 0.25) AS q25, quantile_cont({c}, 0.5) AS q50, "
            f"quantile_cont({c}, 0.75) AS q75, max({c})::double AS max, NULL::bigint AS \"unique\", "
            f"NULL::varchar AS top, NULL::bigint AS freq FROM v_null")


@query("profile_summary", with_views(MEASURE_NULL) + f"""
SELECT "column", count, round(mean, 6) AS mean, round(std, 6) AS std, round(min, 6) AS min, round(q25, 6) AS q25,
  round(q50, 6) AS q50, round(q75, 6) AS q75, round(max, 6) AS max, "unique", top, freq FROM (
{' UNION ALL '.join(_num_summary(c) for c in NUMERIC)}
UNION ALL SELECT 'l_linestatus', sum(m)::bigint, NULL, NULL, NULL, NULL, NULL, NULL, NULL, count(*),
  arg_min(l_linestatus, -m), max(m) FROM (SELECT l_linestatus, count(*) AS m FROM v_null
  WHERE l_linestatus IS NOT NULL GROUP BY 1))""")
def profile_summary(spark, sf_dir):
    return P.profile_summary(measure_null(spark, sf_dir), NUMERIC, ["l_linestatus"])


@query("outlier_zscore", with_views(MEASURE) + f"""
SELECT {KEYS}, l_quantity, l_extendedprice, coalesce(abs(l_quantity-mq)/sq>1.6, false) AS l_quantity_outlier,
  coalesce(abs(l_extendedprice-mp)/sp>1.6, false) AS l_extendedprice_outlier FROM v_measure,
  (SELECT avg(l_quantity) mq, stddev_pop(l_quantity) sq, avg(l_extendedprice) mp, stddev_pop(l_extendedprice) sp
   FROM v_measure)""")
def outlier_zscore(spark, sf_dir):
    m = measure(spark, sf_dir).select(*MEASURE_KEYS, "l_quantity", "l_extendedprice")
    return P.outlier_zscore(m, ["l_quantity", "l_extendedprice"], z=1.6)


SQL_IQR = """iqr AS (SELECT quantile_cont(l_quantity, 0.25) q1, quantile_cont(l_quantity, 0.75) q3,
  quantile_cont(l_extendedprice, 0.25) p1, quantile_cont(l_extendedprice, 0.75) p3 FROM v_measure)"""


@query("outlier_iqr", with_views(MEASURE, SQL_IQR) + f"""
SELECT {KEYS}, l_quantity, l_extendedprice,
  (l_quantity < q1-0.4*(q3-q1) OR l_quantity > q3+0.4*(q3-q1)) AS l_quantity_outlier,
  (l_extendedprice < p1-0.4*(p3-p1) OR l_extendedprice > p3+0.4*(p3-p1)) AS l_extendedprice_outlier
FROM v_measure, iqr""")
def outlier_iqr(spark, sf_dir):
    m = measure(spark, sf_dir).select(*MEASURE_KEYS, "l_quantity", "l_extendedprice")
    return P.outlier_iqr(m, ["l_quantity", "l_extendedprice"], k=0.4)


def _outlier_count(c: str) -> str:
    return f"""SELECT '{c}' AS "column", sum((abs({c}-m)/s>1.6)::int)::bigint AS zscore_count,
  sum(({c}<a-0.4*(b-a) OR {c}>b+0.4*(b-a))::int)::bigint AS iqr_count FROM v_measure, (SELECT avg({c}) m,
  stddev_pop({c}) s, quantile_cont({c}, 0.25) a, quantile_cont({c}, 0.75) b FROM v_measure)"""


@query("outlier_counts", with_views(MEASURE) + " UNION ALL ".join(_outlier_count(c) for c in NUMERIC))
def outlier_counts(spark, sf_dir):
    return P.outlier_counts(measure(spark, sf_dir), NUMERIC, z=1.6, k=0.4)


SQL_FLAGS = """, v_flags AS (SELECT *, lo>hi AS flag_low_gt_high, hi>8 AS flag_high_extreme, lo<1 AS flag_low_extreme,
  hi<0 AS flag_high_negative, lo<0 AS flag_low_negative, hi<0 OR lo<0 AS flag_negative FROM v_signed)
"""


def _flags(spark, sf_dir):
    return P.quality_flags(measure_signed(spark, sf_dir), "hi", "lo", max_high=8, min_low=1)


@query("quality_flags", with_views(MEASURE_SIGNED) + SQL_FLAGS + f"""
SELECT {KEYS}, hi, lo, flag_low_gt_high, flag_high_extreme, flag_low_extreme, flag_high_negative,
  flag_low_negative, flag_negative FROM v_flags""")
def quality_flags(spark, sf_dir):
    return _flags(spark, sf_dir).drop("l_quantity", "l_extendedprice", "l_linestatus", "target")


@query("duplicate_flag", with_views(MEASURE_DUP) + """
SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
  hi, lo, l_linestatus, target) > 1 AS flag_duplicate FROM v_dup""")
def duplicate_flag(spark, sf_dir):
    return P.duplicate_flag(measure_dup(spark, sf_dir))


SQL_DUP_FLAGS = MEASURE_DUP + """, v_flags AS (SELECT *, lo>hi-1 AS flag_low_gt_high, hi-1>8 AS flag_high_extreme,
  lo<1 AS flag_low_extreme, hi-1<0 AS flag_high_negative, lo<0 AS flag_low_negative,
  count(*) OVER (PARTITION BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, hi, lo, l_linestatus, target)>1 AS flag_duplicate FROM v_dup)
"""


def _dup_flags(spark, sf_dir):
    d = P.duplicate_flag(measure_dup(spark, sf_dir)).withColumn("hi", F.col("hi") - 1)
    return P.quality_flags(d, "hi", "lo", max_high=8, min_low=1)


@query("quality_counts", with_views(SQL_DUP_FLAGS) + " UNION ALL ".join(
    f"SELECT '{f}' AS issue, sum({f}::int)::bigint AS n FROM v_flags" for f in P.QUALITY_FLAGS))
def quality_counts(spark, sf_dir):
    return P.quality_counts(_dup_flags(spark, sf_dir))


@query("flagged_records", with_views(SQL_DUP_FLAGS) + f"""
SELECT {KEYS}, hi-1 AS hi, lo, flag_duplicate FROM v_flags WHERE {' OR '.join(P.QUALITY_FLAGS)}""")
def flagged_records(spark, sf_dir):
    return P.flagged_records(_dup_flags(spark, sf_dir)).select(*MEASURE_KEYS, "hi", "lo", "flag_duplicate")


SQL_SANITY = """, v_sane AS (SELECT *, (lo>hi)::int AS swap_suspect, (hi<2 OR hi>9)::int AS high_unreal,
  (lo<1 OR lo>6)::int AS low_unreal, (hi-lo<=0)::int AS diff_not_positive FROM v_signed)
"""
SANITY = {"high_range": (2, 9), "low_range": (1, 6)}


@query("sanity_flags", with_views(MEASURE_SIGNED) + SQL_SANITY + f"""
SELECT {KEYS}, hi, lo, swap_suspect, high_unreal, low_unreal, diff_not_positive,
  greatest(swap_suspect, high_unreal, low_unreal, diff_not_positive) AS any_flag FROM v_sane""")
def sanity_flags(spark, sf_dir):
    m = measure_signed(spark, sf_dir).select(*MEASURE_KEYS, "hi", "lo")
    return P.sanity_flags(m, "hi", "lo", **SANITY)


@query("filter_sanity", with_views(MEASURE_SIGNED) + SQL_SANITY + f"""
SELECT {KEYS}, hi, lo FROM v_sane WHERE swap_suspect+high_unreal+low_unreal+diff_not_positive=0""")
def filter_sanity(spark, sf_dir):
    m = measure_signed(spark, sf_dir).select(*MEASURE_KEYS, "hi", "lo")
    return P.filter_sanity(m, "hi", "lo", strict=True, **SANITY)


@query("filter_sanity_lenient", with_views(MEASURE_SIGNED) + SQL_SANITY + f"""
SELECT {KEYS}, hi, lo FROM v_sane WHERE swap_suspect+diff_not_positive=0""")
def filter_sanity_lenient(spark, sf_dir):
    m = measure_signed(spark, sf_dir).select(*MEASURE_KEYS, "hi", "lo")
    return P.filter_sanity(m, "hi", "lo", **SANITY)


@query("quality_report", with_views(MEASURE_NULL) + """,
d AS (SELECT * FROM v_null UNION ALL SELECT * FROM v_null WHERE l_orderkey%101=0), t AS (SELECT count(*) AS r FROM d),
i AS (SELECT 'data_fix' AS category, 'lo>hi' AS feature, sum((lo>hi)::int) AS n, 1 AS w, 'High' AS severity FROM d
UNION ALL SELECT 'data_fix', 'hi', sum((hi>8)::int), 1, 'Medium' FROM d
UNION ALL SELECT 'data_fix', 'lo', sum((lo<1)::int), 1, 'Medium' FROM d
UNION ALL SELECT 'missing', '*', sum((l_quantity IS NULL)::int+(l_linestatus IS NULL)::int), 10, 'Medium' FROM d
UNION ALL SELECT 'outlier', 'l_quantity', sum((l_quantity<3 OR l_quantity>48)::int), 1, 'Low' FROM d
UNION ALL SELECT 'outlier', 'l_extendedprice', sum((l_extendedprice<0)::int), 1, 'Low' FROM d
UNION ALL SELECT 'class_imbalance', 'target', abs(sum(target)-sum(1-target)), 1, 'High' FROM d
UNION ALL SELECT 'duplicate', '*', sum(m-1), 1, 'Low' FROM (SELECT count(*) AS m FROM d GROUP BY
  l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, hi, lo, l_linestatus, target))
SELECT category, feature, n::bigint AS n, round(100*n/(r*w)::double, 6) AS pct, severity FROM i, t WHERE n>0""")
def quality_report(spark, sf_dir):
    m = measure_null(spark, sf_dir)
    d = m.unionAll(m.filter(F.col("l_orderkey") % 101 == 0))
    return P.quality_report(d, high="hi", low="lo", max_high=8, min_low=1, target="target",
                            ranges={"l_quantity": (3, 48), "l_extendedprice": (0, 1e9)})


@query("missing_counts", with_views(MEASURE_NULL) + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", sum(({c} IS NULL)::int)::bigint AS n,
    round(100*avg(({c} IS NULL)::int), 6) AS pct FROM v_null""" for c in ("l_quantity", "l_linestatus", "hi")))
def missing_counts(spark, sf_dir):
    return P.missing_counts(measure_null(spark, sf_dir), ["l_quantity", "l_linestatus", "hi"])


@query("class_balance", with_views(MEASURE) + """, c AS (SELECT target, count(*) AS n FROM v_measure GROUP BY 1),
s AS (SELECT target AS class, n, n/sum(n) OVER ()::double AS share FROM c)
SELECT class, n, round(share, 6) AS share, abs(1-2*share)>0.1 AS imbalanced,
  (SELECT share<0.45 OR share>0.55 FROM s WHERE class=1) AS outside_band FROM s""")
def class_balance(spark, sf_dir):
    return P.class_balance(measure(spark, sf_dir), "target")


@query("target_rate_by_category", with_views(MEASURE) + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", cast({c} AS varchar) AS level, count(*) AS n, round(avg(target), 6) AS rate
    FROM v_measure GROUP BY 2""" for c in ("l_linenumber", "l_linestatus", "hi", "lo")))
def target_rate_by_category(spark, sf_dir):
    return P.target_rate_by_category(measure(spark, sf_dir), ["l_linenumber", "l_linestatus", "hi", "lo"], "target")


@query("group_means", with_views(MEASURE) + """
SELECT target, count(*) AS n, round(avg(l_quantity), 6) AS mean_l_quantity, round(avg(hi), 6) AS mean_hi,
  round(avg((l_quantity>30)::int), 6) AS share_large FROM v_measure GROUP BY 1""")
def group_means(spark, sf_dir):
    return P.group_means(measure(spark, sf_dir), "target", ["l_quantity", "hi"],
                         {"share_large": F.col("l_quantity") > 30})


def _binned(c: str, edges: list[int]) -> str:
    case = " ".join(f"WHEN {c}>{a} AND {c}<={b} THEN {i}" for i, (a, b) in enumerate(zip(edges[:-1], edges[1:])))
    e = "[" + ", ".join(f"{v}::double" for v in edges) + "]"
    return f"""SELECT '{c}' AS "column", bin::int AS bin, count(*) AS n, round(avg(target), 6) AS rate,
      {e}[bin+1] AS lower, {e}[bin+2] AS upper FROM (SELECT CASE {case} END AS bin, target FROM v_measure)
      WHERE bin IS NOT NULL GROUP BY bin"""


BINS = {"l_quantity": [5, 10, 20, 30, 45], "l_extendedprice": [10000, 20000, 40000, 60000], "hi": [0, 2, 5, 9],
        "lo": [0, 4, 8]}


@query("binned_target_rate", with_views(MEASURE) + " UNION ALL ".join(_binned(c, e) for c, e in BINS.items()))
def binned_target_rate(spark, sf_dir):
    return P.binned_target_rate(measure(spark, sf_dir), BINS, "target")


@query("class_histogram", with_views(MEASURE) + """
SELECT target, least(floor((l_extendedprice-lo0)/(hi0-lo0)*30), 29)::int AS bin, count(*) AS n FROM v_measure
JOIN (SELECT target, min(l_extendedprice) AS lo0, max(l_extendedprice) AS hi0 FROM v_measure GROUP BY 1) USING (target)
GROUP BY 1, 2""")
def class_histogram(spark, sf_dir):
    return P.class_histogram(measure(spark, sf_dir), "l_extendedprice", "target")


def _box(c: str) -> str:
    return f"""SELECT target, '{c}' AS "column", n, q1, q2, q3, min(x) FILTER (x>=q1-0.3*(q3-q1)) AS wl,
  max(x) FILTER (x<=q3+0.3*(q3-q1)) AS wh FROM (SELECT target, {c}::double AS x FROM v_measure) JOIN (
  SELECT target, count(*) AS n, quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS q2,
  quantile_cont({c}, 0.75) AS q3 FROM v_measure GROUP BY 1) USING (target) GROUP BY ALL"""


@query("class_quartiles", with_views(MEASURE) + f"""
SELECT target, "column", n, round(q1, 6) AS q1, round(q2, 6) AS median, round(q3, 6) AS q3, round(wl, 6) AS whisker_low,
  round(wh, 6) AS whisker_high FROM ({' UNION ALL '.join(_box(c) for c in ('l_quantity', 'l_extendedprice', 'hi'))})""")
def class_quartiles(spark, sf_dir):
    return P.class_quartiles(measure(spark, sf_dir), ["l_quantity", "l_extendedprice", "hi"], "target", k=0.3)


@query("count_by_value_class", with_views(MEASURE) + """
SELECT v.value, c.class, coalesce(n, 0)::bigint AS n FROM (SELECT DISTINCT hi*10+lo AS value FROM v_measure) v CROSS JOIN (SELECT unnest([0, 1]) AS class) c LEFT JOIN (SELECT hi*10+lo AS value,
  target AS class, count(*) AS n FROM v_measure GROUP BY 1, 2) x
  ON v.value=x.value AND c.class=x.class""")
def count_by_value_class(spark, sf_dir):
    m = measure(spark, sf_dir)
    return P.count_by_value_class(m, F.col("hi") * 10 + F.col("lo"), "target")


@query("count_by_state_class", with_views(MEASURE) + """
SELECT CASE WHEN l_quantity>=18.5 AND l_quantity<25 THEN 'Normal' ELSE 'Abnormal' END AS state, target AS class,
  count(*) AS n FROM v_measure GROUP BY 1, 2""")
def count_by_state_class(spark, sf_dir):
    return P.count_by_value_class(measure(spark, sf_dir), two_state("l_quantity"), "target", name="state")


@query("ordinal_trend", with_views(MEASURE) + """
SELECT round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept, count(*) AS levels FROM (
  SELECT l_linenumber::double AS x, 100*avg(target) AS y FROM v_measure GROUP BY 1)""")
def ordinal_trend(spark, sf_dir):
    return P.ordinal_trend(measure(spark, sf_dir), "l_linenumber", "target")


@query("poly_trend")
def poly_trend(spark, sf_dir):
    return P.poly_trend(measure(spark, sf_dir), "l_quantity", "target")


@query("dedupe_rows", with_views(MEASURE_DUP) + "SELECT DISTINCT * FROM v_dup")
def dedupe_rows(spark, sf_dir):
    return P.dedupe_rows(measure_dup(spark, sf_dir))


@query("domain_repair", with_views(MEASURE) + f"""
SELECT {KEYS}, CASE WHEN hi IN (3, 4, 5, 6, 7) THEN hi ELSE (SELECT hi FROM v_measure GROUP BY hi
  ORDER BY count(*) DESC, hi LIMIT 1) END AS hi, lo FROM v_measure WHERE lo IN (1, 2, 3, 4, 5, 6)""")
def domain_repair(spark, sf_dir):
    m = measure(spark, sf_dir).select(*MEASURE_KEYS, "hi", "lo")
    return P.domain_repair(m, "hi", [3, 4, 5, 6, 7], "lo", [1, 2, 3, 4, 5, 6])
