"""Attribution summary and enrichment queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsight.operators import attribution as I
from tabsight.plans.registry import query
from tabsight.plans.views import (ATTR, FAMILY, STEP_FEATURES, attribution_matrix, attributions, customer_features,
                                  family, table, with_views)

LABELS = ["id", "fold", "cohort", "target"]
# step means per row and feature
MEANS = ATTR + """, v_mean AS (SELECT id, fold, cohort, target, feature, avg(score) AS score, max(score) AS top
  FROM v_attr GROUP BY ALL)
"""


def step_means(spark, sf_dir, how: str = "mean") -> DataFrame:
    return I.step_aggregate_matrix(attribution_matrix(spark, sf_dir), "matrix", STEP_FEATURES, how, LABELS)


@query("step_aggregate", with_views(ATTR) + """
SELECT id, feature, round(avg(score), 6) AS mean_score, round(max(score), 6) AS max_score,
  round(sum(score), 6) AS sum_score FROM v_attr GROUP BY 1, 2""")
def step_aggregate(spark, sf_dir):
    a, keys = attributions(spark, sf_dir), ["id", "feature"]
    out = I.step_aggregate(a, "mean").withColumnRenamed("score", "mean_score")
    for how in ("max", "sum"):
        out = out.join(I.step_aggregate(a, how).withColumnRenamed("score", f"{how}_score"), keys)
    return out


@query("step_aggregate_matrix", with_views(MEANS) + "SELECT id, feature, round(score, 6) AS score FROM v_mean")
def step_aggregate_matrix(spark, sf_dir):
    return step_means(spark, sf_dir).select("id", "feature", "score")


@query("attribution_global", with_views(MEANS) + """
SELECT 'fold_'||fold AS fold, feature, round(avg(score), 6) AS mean_score, NULL::double AS std_score,
  count(*) AS n_samples FROM v_mean GROUP BY 1, 2
UNION ALL SELECT 'global', feature, round(avg(score), 6), round(stddev_pop(score), 6), count(*) FROM v_mean GROUP BY 2""")
def attribution_global(spark, sf_dir):
    return I.attribution_global(step_means(spark, sf_dir))


@query("attribution_by_cohort", with_views(MEANS) + """
SELECT 'cohort' AS scope, 'cohort='||cohort AS "group", feature, round(avg(score), 6) AS mean_score,
  count(*) AS n_samples FROM v_mean WHERE id%7<>0 GROUP BY 2, 3
UNION ALL SELECT 'target', 'target='||target, feature, round(avg(score), 6), count(*) FROM v_mean WHERE id%7<>0
GROUP BY 2, 3""")
def attribution_by_cohort(spark, sf_dir):
    cohorts = table(spark, sf_dir, "embeddings").filter("vec_id % 7 <> 0").select(
        F.col("vec_id").alias("id"), F.col("label").alias("cohort"), (F.col("label") >= 5).cast("int").alias("target"))
    return I.attribution_by_cohort(step_means(spark, sf_dir), cohorts)


def _global(spark, sf_dir, how="mean") -> DataFrame:
    return I.attribution_global(step_means(spark, sf_dir, how)).filter("fold = 'global'")


@query("top_features", with_views(MEANS) + """,
g AS (SELECT feature, avg(score) AS mean_score FROM v_mean GROUP BY 1)
SELECT feature, round(mean_score, 6) AS mean_score,
  (SELECT count(*) FROM g WHERE mean_score>(SELECT avg(mean_score) FROM g)) AS above_mean
FROM g ORDER BY g.mean_score DESC, feature LIMIT 10""")
def top_features(spark, sf_dir):
    return I.top_features(_global(spark, sf_dir), 10)


SQL_TWO = MEANS + """, v_a AS (SELECT feature, avg(score) AS a_mean FROM v_mean WHERE feature NOT IN ('f0', 'f1') GROUP BY 1),
v_b AS (SELECT feature, avg(top) AS b_mean FROM v_mean WHERE feature NOT IN ('f14', 'f15') GROUP BY 1),
v_two AS (SELECT feature, a_mean, b_mean FROM v_a FULL JOIN v_b USING (feature))
"""


def _two(spark, sf_dir):
    return (_global(spark, sf_dir).filter(~F.col("feature").isin("f0", "f1")),
            _global(spark, sf_dir, "max").filter(~F.col("feature").isin("f14", "f15")))


@query("importance_compare", with_views(SQL_TWO) + """
SELECT feature, round(a_mean, 6) AS a_mean, round(b_mean, 6) AS b_mean FROM v_two""")
def importance_compare(spark, sf_dir):
    return I.importance_compare(*_two(spark, sf_dir))


@query("family_contribution", with_views(SQL_TWO) + """
SELECT f.feature, round(CASE WHEN a_mean>0 AND b_mean IS NOT NULL THEN b_mean/a_mean ELSE 0 END, 6) AS ratio,
  round(a_pct, 6) AS a_pct, round(b_pct, 6) AS b_pct FROM (SELECT unnest(['f0', 'f3', 'f7', 'f15']) AS feature) f
LEFT JOIN v_two USING (feature), (SELECT 100*sum(a_mean) FILTER (feature IN ('f0', 'f3', 'f7', 'f15'))/sum(a_mean) AS a_pct,
  100*sum(b_mean) FILTER (feature IN ('f0', 'f3', 'f7', 'f15'))/sum(b_mean) AS b_pct FROM v_two)""")
def family_contribution(spark, sf_dir):
    return I.family_contribution(*_two(spark, sf_dir), ["f0", "f3", "f7", "f15"])


@query("importance_pivot", with_views(MEANS) + "SELECT feature, " + ", ".join(
    f"round(coalesce(avg(score) FILTER (fold={f}), 0), 6) AS fold_{f}" for f in range(5)) + """
FROM v_mean GROUP BY feature ORDER BY avg(score) FILTER (fold=0) DESC, feature LIMIT 12""")
def importance_pivot(spark, sf_dir):
    return I.importance_pivot(step_means(spark, sf_dir), range(5), 12)


@query("importance_summary", with_views(MEANS) + """,
f AS (SELECT fold, feature, avg(score) AS v FROM v_mean GROUP BY 1, 2)
SELECT feature, 'global' AS scope, 'all' AS "group", round(avg(v), 6) AS mean_importance,
  round(stddev_samp(v), 6) AS std_importance, count(*) AS n_samples, 'rf' AS model FROM f GROUP BY 1
UNION ALL SELECT feature, 'fold', 'fold_'||fold, round(v, 6), NULL, NULL, 'rf' FROM f""")
def importance_summary(spark, sf_dir):
    per = step_means(spark, sf_dir).groupBy("fold", "feature").agg(F.avg("score").alias("importance"))
    return I.importance_summary(per)


def enriched(spark, sf_dir) -> DataFrame:
    c = customer_features(spark, sf_dir)
    parts = [c.filter("o_custkey % 5 <> 0"), c.filter("o_custkey % 5 = 0")]
    return I.enrich_predictions(family(spark, sf_dir), parts, "o_custkey")


@query("enrich_predictions", with_views(FAMILY) + """
SELECT id, y, p_a, o_custkey, c_acctbal, c_mktsegment, c_mktsegment IS NOT NULL AS matched FROM v_family""")
def enrich_predictions(spark, sf_dir):
    return enriched(spark, sf_dir)


@query("enrich_stats", with_views(FAMILY) + """
SELECT count(*) AS rows, count(c_mktsegment) AS matched, count(*)-count(c_acctbal) AS missing_c_acctbal,
  count(*)-count(c_mktsegment) AS missing_c_mktsegment FROM v_family""")
def enrich_stats(spark, sf_dir):
    return I.enrich_stats(enriched(spark, sf_dir), ["c_acctbal", "c_mktsegment"])


SQL_RISK = FAMILY + """, v_risk AS (SELECT *, c_acctbal/10000 AS risk, (c_mktsegment='BUILDING')::int AS building,
  CASE WHEN c_acctbal/10000<-0.25 THEN 'Very Good' WHEN c_acctbal/10000<0 THEN 'Good' WHEN c_acctbal/10000<=0.5
  THEN 'Medium' ELSE 'Bad' END AS band FROM v_family WHERE c_acctbal IS NOT NULL)
"""


def risky(spark, sf_dir) -> DataFrame:
    return enriched(spark, sf_dir).withColumns({
        "risk": F.col("c_acctbal") / 10000, "building": (F.col("c_mktsegment") == "BUILDING").cast("int")})


@query("detail_table", with_views(SQL_RISK) + """
SELECT id, y, p_a, round(risk, 6) AS risk, building, band FROM v_risk""")
def detail_table(spark, sf_dir):
    return I.detail_table(risky(spark, sf_dir), ["c_acctbal", "c_mktsegment"], "risk", p="p_a",
                          columns=["id", "y", "p_a", "risk", "building"])


@query("distribution_stats", with_views(SQL_RISK) + """
SELECT round(min(risk), 6) AS min, round(max(risk), 6) AS max, round(avg(risk), 6) AS mean,
  round(stddev_samp(risk), 6) AS std, count(*) FILTER (risk<0) AS good, count(*) FILTER (risk>=0 AND risk<=0.5) AS medium,
  count(*) FILTER (risk>0.5) AS bad, count(*) FILTER (building=0) AS building_0,
  count(*) FILTER (building=1) AS building_1 FROM v_risk""")
def distribution_stats(spark, sf_dir):
    return I.distribution_stats(risky(spark, sf_dir), "risk", ["building"])


@query("band_stats", with_views(SQL_RISK) + """
SELECT band, round(avg(p_a), 6) AS mean_prob, round(stddev_samp(p_a), 6) AS std_prob, count(*) AS n,
  round(avg(y), 6) AS positive_rate, round(avg(((p_a>=0.5)=(y=1))::int), 6) AS accuracy FROM v_risk GROUP BY 1""")
def band_stats(spark, sf_dir):
    d = I.detail_table(risky(spark, sf_dir), ["c_acctbal", "c_mktsegment"], "risk", p="p_a",
                       columns=["id", "y", "p_a"])
    return I.band_stats(d, "band", y="y", p="p_a")
