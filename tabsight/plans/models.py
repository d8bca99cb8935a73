"""Training, calibration and scoring queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsight.operators import attribution as I
from tabsight.operators import metrics as M
from tabsight.operators import models as T
from tabsight.operators.splits import stratified_folds
from tabsight.plans.registry import query
from tabsight.plans.views import MEASURE, MEASURE_KEYS, PRED_LONG, measure, predictions_long, with_views
from tabsight.sources.files import materialised

FEATURES = ["l_quantity", "l_extendedprice", "hi", "lo", "l_linenumber"]
FOLDS = 5


def train(spark, sf_dir) -> DataFrame:
    return measure(spark, sf_dir).select(*MEASURE_KEYS, "target", *[c for c in FEATURES if c not in MEASURE_KEYS])


def features() -> list[str]:
    return [c for c in FEATURES if c not in MEASURE_KEYS]


@query("class_weights", with_views(MEASURE) + """
SELECT target, n, round(t/(k*n)::double, 6) AS weight FROM (SELECT target, count(*) AS n FROM v_measure GROUP BY 1),
  (SELECT count(*) AS t, count(DISTINCT target) AS k FROM v_measure)""")
def class_weights(spark, sf_dir):
    return T.class_weights(measure(spark, sf_dir), "target")


@query("forest_oof")
def forest_oof(spark, sf_dir):
    return T.forest_oof(train(spark, sf_dir), "target", MEASURE_KEYS, features(), k=FOLDS)


@query("forest_oof_metrics")
def forest_oof_metrics(spark, sf_dir):
    oof = materialised(T.forest_oof(train(spark, sf_dir), "target", MEASURE_KEYS, features(), k=FOLDS))
    return M.all_metrics(oof, by=["model", "fold"])


@query("forest_search")
def forest_search(spark, sf_dir):
    return T.forest_search(train(spark, sf_dir), "target", MEASURE_KEYS, features())


@query("calibrate_platt")
def calibrate_platt(spark, sf_dir):
    return T.cross_calibrate(predictions_long(spark, sf_dir), "platt")


def sql_isotonic(src: str, by: str) -> str:
    """Isotonic values per distinct score as a CTE ``iso`` (by, p, v): max over starts of min over ends of the means."""
    return f"""ic AS (SELECT {by}, y_pred AS p, sum(y_true)::double AS pos, count(*)::double AS w,
  row_number() OVER (PARTITION BY {by} ORDER BY y_pred) AS i FROM {src} GROUP BY {by}, y_pred),
cum AS (SELECT *, sum(pos) OVER q AS cp, sum(w) OVER q AS cw FROM ic
  WINDOW q AS (PARTITION BY {by} ORDER BY i ROWS UNBOUNDED PRECEDING)),
ends AS (SELECT j.{by}, j.i AS j, k.i AS k, min((k.cp-j.cp+j.pos)/(k.cw-j.cw+j.w)) OVER (PARTITION BY j.{by}, j.i
  ORDER BY k.i DESC ROWS UNBOUNDED PRECEDING) AS m FROM cum j JOIN cum k ON j.{by}=k.{by} AND j.i<=k.i),
iso AS (SELECT c.{by}, c.p, e.v FROM cum c JOIN (SELECT {by}, k, max(m) AS v FROM ends GROUP BY 1, 2) e
  ON c.{by}=e.{by} AND c.i=e.k)"""


@query("calibrate_isotonic", with_views(PRED_LONG, """fit AS (SELECT concat(v.model, f.fold) AS cell, y_true, y_pred
  FROM v_long v JOIN (SELECT DISTINCT fold FROM v_long) f ON v.fold<>f.fold)""", sql_isotonic("fit", "cell")) + """
SELECT id, fold, model, y_true, round(CASE WHEN a.p IS NULL THEN b.v WHEN b.p IS NULL OR a.p=b.p THEN a.v
  ELSE a.v+(b.v-a.v)*(y_pred-a.p)/(b.p-a.p) END, 6) AS y_pred FROM (SELECT *, concat(model, fold) AS cell FROM v_long) t
ASOF LEFT JOIN iso a ON t.cell=a.cell AND t.y_pred>=a.p ASOF LEFT JOIN iso b ON t.cell=b.cell AND t.y_pred<=b.p""")
def calibrate_isotonic(spark, sf_dir):
    return T.cross_calibrate(predictions_long(spark, sf_dir), "isotonic")


def _sql_side(tag: str) -> str:
    return f"""{tag}0 AS (SELECT model, fold, y_true AS y, {tag} AS p FROM ver UNION ALL
  SELECT model, -1, y_true, {tag} FROM ver),
{tag}b AS (SELECT model, fold, avg((p-y)*(p-y)) AS brier FROM {tag}0 GROUP BY 1, 2),
{tag}e AS (SELECT model, fold, sum(abs(a-c)*n)/sum(n) AS ece FROM (SELECT model, fold, avg(y::double) AS a, avg(p) AS c,
  count(*) AS n FROM {tag}0 GROUP BY model, fold, least(floor(p*15), 14)) GROUP BY 1, 2)"""


DELTA = """
SELECT a.model, a.fold, round(a.brier, 6) AS brier_pre, round(b.ece, 6) AS ece_pre, round(c.brier, 6) AS brier_post,
  round(d.ece, 6) AS ece_post, round(c.brier-a.brier, 6) AS delta_brier, round(d.ece-b.ece, 6) AS delta_ece
FROM preb a JOIN pree b USING (model, fold) JOIN postb c USING (model, fold) JOIN poste d USING (model, fold)"""


@query("calibration_report", with_views(PRED_LONG, "own AS (SELECT *, concat(model, fold) AS cell FROM v_long)",
                                        sql_isotonic("own", "cell"), """ver AS (SELECT model, o.fold, y_true, y_pred AS pre,
  v AS post FROM own o JOIN iso ON o.cell=iso.cell AND o.y_pred=iso.p)""", _sql_side("pre"), _sql_side("post")) + DELTA)
def calibration_report(spark, sf_dir):
    return T.calibration_report(predictions_long(spark, sf_dir), "isotonic", folds=range(5))


@query("calibration_delta", with_views(PRED_LONG, """ver AS (SELECT model, fold, y_true, y_pred AS pre,
  least(greatest(y_pred*1.1-0.0502, 0), 1)::double AS post FROM v_long)""", _sql_side("pre"), _sql_side("post")) + DELTA)
def calibration_delta(spark, sf_dir):
    p = predictions_long(spark, sf_dir)
    post = F.least(F.greatest(F.col("y_pred") * 1.1 - 0.0502, F.lit(0.0)), F.lit(1.0))
    return T.calibration_delta(p, p.withColumn("y_pred", post))


@query("final_scoring")
def final_scoring(spark, sf_dir):
    return T.final_scoring(train(spark, sf_dir), "target", MEASURE_KEYS, features())


@query("forest_importance")
def forest_importance(spark, sf_dir):
    t = train(spark, sf_dir)
    folded = materialised(stratified_folds(t, "target", MEASURE_KEYS, k=FOLDS))
    return I.importance_summary(T.forest_importance(folded, "target", MEASURE_KEYS, features(), k=FOLDS))


@query("fold_ensemble_scoring")
def fold_ensemble_scoring(spark, sf_dir):
    return T.fold_ensemble_scoring(train(spark, sf_dir), "target", MEASURE_KEYS, features())


@query("forest_attribution")
def forest_attribution(spark, sf_dir):
    return T.forest_attribution(train(spark, sf_dir), "target", MEASURE_KEYS, features())


@query("row_attribution")
def row_attribution(spark, sf_dir):
    return T.row_attribution(train(spark, sf_dir), "target", MEASURE_KEYS, features())
