"""Prediction-metric queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabsight.operators import metrics as M
from tabsight.plans.registry import query
from tabsight.plans.views import (PRED, PRED_LONG, TEXT_LABEL, predictions_long, table, text_labels, with_views)

# running counts per (model, score), highest score first
SQL_RANKED = PRED_LONG + """, v_cnt AS (SELECT model, y_pred AS score, sum(y_true)::bigint AS pos, count(*) AS n
  FROM v_long GROUP BY 1, 2),
v_rank AS (SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w AS m,
  sum(pos) OVER (PARTITION BY model) AS p_all, sum(n) OVER (PARTITION BY model) AS n_all
  FROM v_cnt WINDOW w AS (PARTITION BY model ORDER BY score DESC ROWS UNBOUNDED PRECEDING))
"""
BY = ["model"]


def _counts(spark, sf_dir):
    return M.score_counts(predictions_long(spark, sf_dir), by=BY)


@query("roc_auc", with_views(SQL_RANKED) + """
SELECT model, round(sum(pos*((n_all-p_all)-(m-tp)+0.5*(n-pos)))/(max(p_all)*max(n_all-p_all))::double, 6) AS roc_auc
FROM v_rank GROUP BY model""")
def roc_auc(spark, sf_dir):
    return M.roc_auc(_counts(spark, sf_dir), BY)


@query("average_precision", with_views(SQL_RANKED) + """
SELECT model, round(sum(pos*tp/m::double)/max(p_all), 6) AS pr_auc FROM v_rank GROUP BY model""")
def average_precision(spark, sf_dir):
    return M.average_precision(_counts(spark, sf_dir), BY)


@query("text_quality_ranking", with_views(TEXT_LABEL) + """,
c AS (SELECT score, sum(y)::bigint AS pos, count(*) AS n FROM v_text GROUP BY 1),
r AS (SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w AS m, sum(pos) OVER () AS p_all, sum(n) OVER () AS n_all
  FROM c WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING))
SELECT 'n_chars' AS model,
  round(sum(pos*((n_all-p_all)-(m-tp)+0.5*(n-pos)))/(max(p_all)*max(n_all-p_all))::double, 6) AS roc_auc,
  round(sum(pos*tp/m::double)/max(p_all), 6) AS pr_auc FROM r""")
def text_quality_ranking(spark, sf_dir):
    t = text_labels(spark, sf_dir).withColumn("model", F.lit("n_chars"))
    return M.ranking_metrics(M.score_counts(t, by=BY, y="y", p="score"), BY).drop("distinct")


@query("basic_metrics", with_views(PRED_LONG) + """
SELECT model, round(avg(((y_pred>=0.5)=(y_true=1))::int), 6) AS accuracy,
  round(2*sum((y_pred>=0.5 AND y_true=1)::int)/(sum((y_pred>=0.5)::int)+sum(y_true))::double, 6) AS f1,
  round(avg((y_pred-y_true)*(y_pred-y_true)), 6) AS brier FROM v_long GROUP BY model""")
def basic_metrics(spark, sf_dir):
    return M.basic_metrics(predictions_long(spark, sf_dir), by=BY)


SQL_CONF = """c AS (SELECT model, {extra}
  sum((y_true=0 AND NOT f)::int)::bigint AS tn, sum((y_true=0 AND f)::int)::bigint AS fp,
  sum((y_true=1 AND NOT f)::int)::bigint AS fn, sum((y_true=1 AND f)::int)::bigint AS tp
  FROM ({src}) GROUP BY ALL)"""


@query("confusion_matrix", with_views(PRED_LONG, SQL_CONF.format(
    extra="", src="SELECT *, y_pred>=0.5 AS f FROM v_long")) + """
SELECT model, tn, fp, fn, tp, round((tp+tn)/(tp+tn+fp+fn)::double, 6) AS accuracy,
  round(tp/(tp+fp)::double, 6) AS precision, round(tp/(tp+fn)::double, 6) AS recall,
  round(tn/(tn+fp)::double, 6) AS specificity, round(2*tp/(2*tp+fp+fn)::double, 6) AS f1,
  round(tn/(tn+fp)::double, 6) AS tn_share, round(fp/(tn+fp)::double, 6) AS fp_share,
  round(fn/(tp+fn)::double, 6) AS fn_share, round(tp/(tp+fn)::double, 6) AS tp_share FROM c""")
def confusion_matrix(spark, sf_dir):
    return M.confusion_matrix(predictions_long(spark, sf_dir), by=BY)


@query("ece_right_closed", with_views(PRED_LONG) + """
SELECT model, round(sum(g)/sum(n), 6) AS ece FROM (
  SELECT model, abs(sum(y_pred)-sum(y_true)) AS g, count(*) AS n FROM v_long GROUP BY model, ceil(y_pred*10))
GROUP BY model""")
def ece_right_closed(spark, sf_dir):
    return M.ece_right_closed(predictions_long(spark, sf_dir), by=BY, bins=10)


SQL_BINS = """b AS (SELECT model, least(floor(y_pred*15), 14)::int AS bin, count(*) AS n,
  avg(y_true::double) AS accuracy, avg(y_pred) AS confidence FROM v_long GROUP BY 1, 2)"""


@query("reliability_bins", with_views(PRED_LONG, SQL_BINS) + """
SELECT model, bin, n, round(accuracy, 6) AS accuracy, round(confidence, 6) AS confidence,
  round(bin/15.0::double, 6) AS lower, round((bin+1)/15.0::double, 6) AS upper FROM b""")
def reliability_bins(spark, sf_dir):
    return M.reliability_bins(predictions_long(spark, sf_dir), by=BY)


@query("ece_left_closed", with_views(PRED_LONG, SQL_BINS) + """
SELECT model, round(sum(abs(accuracy-confidence)*n)/sum(n), 6) AS ece FROM b GROUP BY model""")
def ece_left_closed(spark, sf_dir):
    return M.ece_left_closed(predictions_long(spark, sf_dir), by=BY)


def sql_grid(keys: str, start: int, stop: int, step: int, scale: int) -> str:
    on = " AND ".join(f"a.{k}=b.{k}" for k in keys.split(", "))
    return f"""g AS (SELECT {', '.join('a.' + k for k in keys.split(', '))}, t,
    2*sum(pos)/(sum(n)+max(b.p))::double AS f1 FROM
    (SELECT {keys}, y_pred, sum(y_true) AS pos, count(*) AS n FROM v_long GROUP BY ALL) a
    JOIN (SELECT {keys}, sum(y_true) AS p FROM v_long GROUP BY ALL) b ON {on}
    JOIN (SELECT unnest(range({start}, {stop}, {step})) AS t) ON a.y_pred >= t/{scale}.0::double GROUP BY ALL),
  best AS (SELECT {keys}, (CASE WHEN f1>0 THEN t/{scale}.0::double ELSE 0.5 END)::double AS threshold, f1
    FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY f1 DESC, t) AS r FROM g) WHERE r=1)"""


@query("best_f1_fine", with_views(PRED_LONG, sql_grid("model", 10, 90, 1, 100)) + """
SELECT model, round(threshold, 6) AS threshold, round(f1, 6) AS f1 FROM best""")
def best_f1_fine(spark, sf_dir):
    return M.best_f1_grid(predictions_long(spark, sf_dir), by=BY)


@query("best_f1_coarse", with_views(PRED_LONG, sql_grid("model", 5, 100, 5, 100)) + """
SELECT model, round(threshold, 6) AS threshold, round(f1, 6) AS f1 FROM best""")
def best_f1_coarse(spark, sf_dir):
    return M.best_f1_grid(predictions_long(spark, sf_dir), by=BY, start=5, stop=100, step=5)


@query("f1_at_recall", with_views(SQL_RANKED) + """,
s AS (SELECT model, score, tp/p_all::double AS rec, tp/m::double AS prec FROM v_rank),
f AS (SELECT *, 2*(prec*rec)/(prec+rec+1e-10) AS f1 FROM s),
q AS (SELECT f.*, r::double AS min_recall, row_number() OVER (PARTITION BY model, r ORDER BY f1 DESC, score) AS k
  FROM f JOIN (SELECT unnest([0.8, 0.9]) AS r) ON rec >= r)
SELECT model, min_recall, round(score, 6) AS threshold, round(f1, 6) AS f1 FROM q WHERE k=1""")
def f1_at_recall(spark, sf_dir):
    return M.f1_at_recall(_counts(spark, sf_dir), BY)


# thresholds fitted on folds 0-3 and applied to fold 4
@query("metrics_at_threshold", with_views(
    PRED_LONG.replace("v_long AS", "v_every AS"), "v_long AS (SELECT * FROM v_every WHERE fold<4)",
    sql_grid("model", 10, 90, 1, 100), SQL_CONF.format(
        extra="threshold,", src="SELECT e.*, threshold, y_pred>=threshold AS f FROM v_every e JOIN best "
        "USING (model) WHERE fold=4")) + """
SELECT model, round(threshold, 6) AS threshold, round(2*tp/(2*tp+fp+fn)::double, 6) AS f1,
  round((tp+tn)/(tp+tn+fp+fn)::double, 6) AS accuracy, round(tp/(tp+fn)::double, 6) AS sensitivity,
  round(tn/(tn+fp)::double, 6) AS specificity FROM c""")
def metrics_at_threshold(spark, sf_dir):
    p = predictions_long(spark, sf_dir)
    policy = M.best_f1_grid(p.filter("fold < 4"), by=BY)
    return M.metrics_at_threshold(p.filter("fold = 4"), policy, by=BY)


@query("composite_metric", with_views(SQL_RANKED) + """
SELECT r.model, round(0.4*auc + 0.4*ap + 0.2*acc, 6) AS composite FROM (
  SELECT model, sum(pos*((n_all-p_all)-(m-tp)+0.5*(n-pos)))/(max(p_all)*max(n_all-p_all))::double AS auc,
  sum(pos*tp/m::double)/max(p_all) AS ap FROM v_rank GROUP BY model) r
JOIN (SELECT model, avg(((y_pred>=0.5)=(y_true=1))::int) AS acc FROM v_long GROUP BY model) b ON r.model=b.model""")
def composite_metric(spark, sf_dir):
    return M.composite_metric(predictions_long(spark, sf_dir), by=BY)


def sql_all(keys: str) -> str:
    """The twelve metrics per group, unrounded, as a CTE named ``am``."""
    return f"""cnt AS (SELECT {keys}, y_pred AS score, sum(y_true)::bigint AS pos, count(*) AS n
  FROM v_long GROUP BY ALL),
rk AS (SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w AS m, sum(pos) OVER (PARTITION BY {keys}) AS p_all,
  sum(n) OVER (PARTITION BY {keys}) AS n_all
  FROM cnt WINDOW w AS (PARTITION BY {keys} ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
auc AS (SELECT {keys}, sum(pos*((n_all-p_all)-(m-tp)+0.5*(n-pos)))/(max(p_all)*max(n_all-p_all))::double AS roc_auc,
  sum(pos*tp/m::double)/max(p_all) AS pr_auc FROM rk GROUP BY ALL),
bas AS (SELECT {keys}, avg(((y_pred>=0.5)=(y_true=1))::int) AS accuracy,
  2*sum((y_pred>=0.5 AND y_true=1)::int)/(sum((y_pred>=0.5)::int)+sum(y_true))::double AS f1,
  avg((y_pred-y_true)*(y_pred-y_true)) AS brier FROM v_long GROUP BY ALL),
ece AS (SELECT {keys}, sum(g)/sum(n) AS ece FROM (SELECT {keys}, abs(sum(y_pred)-sum(y_true)) AS g, count(*) AS n
  FROM v_long GROUP BY {keys}, ceil(y_pred*10)) GROUP BY ALL),
fr AS (SELECT {keys}, score, tp/p_all::double AS rec, 2*((tp/m::double)*(tp/p_all::double))
  /((tp/m::double)+(tp/p_all::double)+1e-10) AS f FROM rk),
r8 AS (SELECT {keys}, f AS f1_recall_08, score AS threshold_recall_08 FROM (SELECT *, row_number() OVER
  (PARTITION BY {keys} ORDER BY f DESC, score) AS k FROM fr WHERE rec>=0.8) WHERE k=1),
r9 AS (SELECT {keys}, f AS f1_recall_09, score AS threshold_recall_09 FROM (SELECT *, row_number() OVER
  (PARTITION BY {keys} ORDER BY f DESC, score) AS k FROM fr WHERE rec>=0.9) WHERE k=1),
{sql_grid(keys, 10, 90, 1, 100)},
am AS (SELECT {keys}, roc_auc, pr_auc, accuracy, bas.f1 AS f1, brier, ece, best.f1 AS f1_best,
  threshold AS threshold_f1, f1_recall_08, threshold_recall_08, f1_recall_09, threshold_recall_09
  FROM auc JOIN bas USING ({keys}) JOIN ece USING ({keys}) JOIN r8 USING ({keys}) JOIN r9 USING ({keys})
  JOIN best USING ({keys}))"""


ROUNDED = ", ".join(f"round({c}, 6) AS {c}" for c in M.ALL_METRICS)


@query("all_metrics", with_views(PRED_LONG, sql_all("model")) + f"SELECT model, {ROUNDED} FROM am")
def all_metrics(spark, sf_dir):
    return M.all_metrics(predictions_long(spark, sf_dir), by=BY)


@query("fold_metrics", with_views(PRED_LONG, sql_all("model, fold")) + f"SELECT model, fold, {ROUNDED} FROM am")
def fold_metrics(spark, sf_dir):
    return M.all_metrics(predictions_long(spark, sf_dir), by=["model", "fold"])


@query("cv_summary", with_views(PRED_LONG, sql_all("model, fold")) + f"""
SELECT model, metric, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, count(v) AS folds
FROM (UNPIVOT am ON {', '.join(M.ALL_METRICS)} INTO NAME metric VALUE v) GROUP BY 1, 2""")
def cv_summary(spark, sf_dir):
    return M.cv_summary(predictions_long(spark, sf_dir), by=BY)


@query("roc_curve", with_views(SQL_RANKED) + """
SELECT model, round(score, 6) AS score, round((m-tp)/(n_all-p_all)::double, 6) AS fpr,
  round(tp/p_all::double, 6) AS tpr FROM v_rank""")
def roc_curve(spark, sf_dir):
    return M.roc_curve(_counts(spark, sf_dir), BY)


@query("pr_curve", with_views(SQL_RANKED) + """
SELECT model, round(score, 6) AS score, round(tp/m::double, 6) AS precision, round(tp/p_all::double, 6) AS recall
FROM v_rank""")
def pr_curve(spark, sf_dir):
    return M.pr_curve(_counts(spark, sf_dir), BY)


@query("pair_predictions", with_views(PRED_LONG) + """
SELECT a.id, a.y_true, a.y_pred AS p_a, b.y_pred AS p_b FROM v_long a JOIN v_long b
ON a.id=b.id AND a.y_true=b.y_true WHERE a.model='a' AND b.model='b' AND a.fold<>1 AND b.fold<>2""")
def pair_predictions(spark, sf_dir):
    p = predictions_long(spark, sf_dir)
    return M.pair_predictions(p.filter("model = 'a' AND fold <> 1"), p.filter("model = 'b' AND fold <> 2"))


@query("fold_ensemble", with_views(PRED_LONG) + """
SELECT id, max(y_true) AS y_true, round(avg(y_pred), 6) AS y_pred, count(*) AS folds FROM v_long GROUP BY id""")
def fold_ensemble(spark, sf_dir):
    return M.fold_ensemble(predictions_long(spark, sf_dir), by=["id"], folds=2)


@query("select_best_fold", with_views(PRED_LONG, sql_all("model, fold")) + """
SELECT model, fold AS selected_fold, round(pr_auc, 6) AS score FROM (SELECT *, row_number() OVER
  (PARTITION BY model ORDER BY pr_auc DESC, fold) AS k FROM am) WHERE k=1""")
def select_best_fold(spark, sf_dir):
    return M.select_best_fold(M.all_metrics(predictions_long(spark, sf_dir), by=["model", "fold"]), by=BY)


# the ordered fold parameters of each nation are stood in for by its suppliers' and customers' figures
@query("aggregate_params", """
WITH p AS (SELECT c_mktsegment AS model, c_nationkey AS fold, 'count' AS param, count(*)::double AS number,
    NULL::varchar AS text FROM customer GROUP BY 1, 2
  UNION ALL SELECT c_mktsegment, c_nationkey, 'mean', avg(c_acctbal), NULL FROM customer GROUP BY 1, 2
  UNION ALL SELECT c_mktsegment, c_nationkey, 'size', NULL, CASE WHEN count(*)>12 THEN 'large'
    WHEN count(*)>9 THEN 'medium' ELSE 'small' END FROM customer GROUP BY 1, 2),
t AS (SELECT model, param, text, row_number() OVER (PARTITION BY model, param ORDER BY c DESC, f) AS k FROM
  (SELECT model, param, text, count(*) AS c, min(fold) AS f FROM p WHERE text IS NOT NULL GROUP BY 1, 2, 3)),
q AS (SELECT model, param, quantile_cont(number, 0.5) AS mid, min((number=floor(number))::int) AS whole
  FROM p GROUP BY ALL)
SELECT q.model, q.param, round(CASE WHEN whole=1 THEN round_even(mid, 0) ELSE mid END, 6) AS number_value,
  CASE WHEN mid IS NULL THEN t.text END AS text_value
FROM q LEFT JOIN t ON q.model=t.model AND q.param=t.param AND k=1""")
def aggregate_params(spark, sf_dir):
    c = (table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("model"), F.col("c_nationkey").alias("fold"))
         .agg(F.count("*").alias("n"), F.avg("c_acctbal").alias("mean")))
    size = F.when(F.col("n") > 12, "large").when(F.col("n") > 9, "medium").otherwise("small")
    none, blank = F.lit(None).cast("double"), F.lit(None).cast("string")
    long = c.select("model", "fold", F.inline(F.array(
        F.struct(F.lit("count").alias("param"), F.col("n").cast("double").alias("number"), blank.alias("text")),
        F.struct(F.lit("mean").alias("param"), F.col("mean").alias("number"), blank.alias("text")),
        F.struct(F.lit("size").alias("param"), none.alias("number"), size.alias("text")))))
    return M.aggregate_params(long)


@query("outcome_listing", with_views(PRED) + """
SELECT id, y AS y_true, p_a AS y_pred, CASE WHEN p_a>=0.5 AND y=1 THEN 'TP' WHEN p_a<0.5 AND y=0 THEN 'TN'
  WHEN p_a>=0.5 THEN 'FP' ELSE 'FN' END AS outcome, CASE WHEN fold<>2 THEN p_b END AS other_pred FROM v_pred""")
def outcome_listing(spark, sf_dir):
    p = predictions_long(spark, sf_dir)
    return M.outcome_listing(p.filter("model = 'a'"), p.filter("model = 'b' AND fold <> 2"))
