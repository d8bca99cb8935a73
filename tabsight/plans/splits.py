"""Split, fold and resampling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabsight.operators import metrics as M
from tabsight.operators import splits as K
from tabsight.plans.registry import query
from tabsight.plans.views import (MEASURE, MEASURE_KEYS, PRED, PRED_LONG, measure, predictions, predictions_long,
                                  sql_hash, with_views)

KEYS = ", ".join(MEASURE_KEYS)
# position within the class by key hash; needs v_measure
SQL_PLACE = f"""v_placed AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY
  ('0x'||substr(md5(concat_ws(':', '42', {KEYS})), 1, 8))::bigint, {KEYS}) AS rn, count(*) OVER (PARTITION BY target) AS n
  FROM v_measure)"""
SQL_PLACED = MEASURE + ", " + SQL_PLACE


def _measure(spark, sf_dir):
    return measure(spark, sf_dir).select(*MEASURE_KEYS, "target")


@query("stratified_split", with_views(SQL_PLACED) + f"""
SELECT {KEYS}, target, CASE WHEN rn<=round(n*0.2::double) THEN 'test' ELSE 'train' END AS split FROM v_placed""")
def stratified_split(spark, sf_dir):
    return K.stratified_split(_measure(spark, sf_dir), "target", MEASURE_KEYS)


@query("stratified_folds", with_views(SQL_PLACED) + f"SELECT {KEYS}, target, ((rn-1)%5)::int AS fold FROM v_placed")
def stratified_folds(spark, sf_dir):
    return K.stratified_folds(_measure(spark, sf_dir), "target", MEASURE_KEYS)


@query("fold_membership", with_views(SQL_PLACED) + f"""
SELECT {KEYS}, f.fold, CASE WHEN (rn-1)%5=f.fold THEN 'val' ELSE 'train' END AS part
FROM v_placed CROSS JOIN (SELECT unnest([0, 1, 2, 3, 4]) AS fold) f""")
def fold_membership(spark, sf_dir):
    return K.fold_membership(K.stratified_folds(_measure(spark, sf_dir), "target", MEASURE_KEYS), MEASURE_KEYS, 5)


@query("oof_integrity", with_views(PRED_LONG) + """,
x AS (SELECT * FROM v_long UNION ALL SELECT id, fold, model, y_true, NULL FROM v_long WHERE model='b' AND id%50=0),
i AS (SELECT model, id, count(*) AS m, sum((y_pred IS NULL)::int) AS bad FROM x GROUP BY 1, 2),
f AS (SELECT model, count(DISTINCT fold) AS folds FROM x GROUP BY 1)
SELECT model, sum(m)::bigint AS rows, count(*) AS ids, sum(bad)::bigint AS missing_pred, sum((m>1)::int)::bigint AS repeated_ids,
  folds::int AS folds, sum((m>1)::int)=0 AND sum(bad)=0 AND folds=5 AS complete
FROM i JOIN f USING (model) GROUP BY model, folds""")
def oof_integrity(spark, sf_dir):
    p = predictions_long(spark, sf_dir)
    gap = p.filter("model = 'b' AND id % 50 = 0").withColumn("y_pred", F.lit(None).cast("double"))
    return K.oof_integrity(p.unionByName(gap))


@query("spotlight_sample", with_views(PRED) + f"""
SELECT id, y, p_a FROM v_pred ORDER BY {sql_hash('42', 'id')}, id LIMIT 20""")
def spotlight_sample(spark, sf_dir):
    return K.spotlight_sample(predictions(spark, sf_dir).select("id", "y", "p_a"), "id")


def _sql_weight(rate: float) -> str:
    cuts = list(enumerate(K.poisson_cuts(rate), start=1))
    return "CASE " + " ".join(f"WHEN u>={cut} THEN {n}" for n, cut in reversed(cuts)) + " ELSE 0 END"


def _sql_uniform(src: str) -> str:
    """``src`` with a 32-bit uniform ``u`` of its columns h0, h1 and step."""
    out = f"(SELECT *, (h0+step*{K.STRIDE})%4294967296 AS u FROM {src})"
    for last in ("xor(xor(u, u>>16), h1)", "xor(u, u>>16)"):
        for _ in range(2):
            out = f"(SELECT * REPLACE ((xor(u, u>>16)*{K.MIX})%4294967296 AS u) FROM {out})"
        out = f"(SELECT * REPLACE ({last} AS u) FROM {out})"
    return out


def _sql_words(keys: str, seed: str) -> str:
    return ", ".join(f"('0x'||substr(md5(concat_ws(':', '{seed}', {keys})), {1 + 8 * i}, 8))::bigint AS h{i}" for i in (0, 1))


def sql_draws(src: str, keys: str, n_boot: int, rate: float = 1.0, seed: str = "boot") -> str:
    """Rows of ``src`` with replicate and positive weight as a CTE ``draws``."""
    rows = f"(SELECT s.*, r::int AS replicate, r*{K.STEPS} AS step FROM (SELECT *, {_sql_words(keys, seed)} FROM {src}) s, range(0, {n_boot}) q(r))"
    return f"draws AS (SELECT * FROM (SELECT *, {_sql_weight(rate)} AS w FROM {_sql_uniform(rows)}) WHERE w>0)"


def sql_cell_draws(src: str, keys: str, n_boot: int, rate: float = 1.0, seed: str = "boot", bits: int = 7) -> str:
    """Rows of ``src``, which stand for ``n`` < 128 rows, with replicate and weights (one per binary digit of n)."""
    rows = (f"(SELECT s.*, j, r::int AS replicate, r*{K.STEPS}+j AS step FROM (SELECT *, {_sql_words(keys, seed)} FROM {src}) s, "
            f"range(0, {n_boot}) q(r), range(0, {bits}) b(j) WHERE (n>>j::int)&1=1)")
    weight = "CASE j " + " ".join(f"WHEN {j} THEN {_sql_weight(rate * 2**j)}" for j in range(bits)) + " END"
    return f"draws AS (SELECT * FROM (SELECT *, {weight} AS w FROM {_sql_uniform(rows)}) WHERE w>0)"


@query("bootstrap_counts", with_views(PRED, sql_draws("v_pred", "id", 200, 0.8)) + """
SELECT replicate, sum(w)::bigint AS drawn, count(*) AS distinct_rows, max(w)::bigint AS max_copies FROM draws GROUP BY 1""")
def bootstrap_counts(spark, sf_dir):
    return K.bootstrap_counts(predictions(spark, sf_dir), ["id"], 200, rate=0.8)


CELLS = """v_cells AS (SELECT p_a, p_b, y, count(*) AS n, floor(p_a*9007199254740992.0::double)::bigint AS ka,
  floor(p_b*9007199254740992.0::double)::bigint AS kb FROM v_pred GROUP BY p_a, p_b, y)"""


@query("bootstrap_ap_ci", with_views(PRED, CELLS, sql_cell_draws("v_cells", "ka, kb, y", 2000)) + """,
l AS (SELECT replicate, 'a' AS model, p_a AS score, w*y AS wy, w FROM draws
  UNION ALL SELECT replicate, 'b', p_b, w*y, w FROM draws),
c AS (SELECT replicate, model, score, sum(wy) AS pos, sum(w) AS n FROM l GROUP BY ALL),
r AS (SELECT *, sum(pos) OVER q AS tp, sum(n) OVER q AS m FROM c
  WINDOW q AS (PARTITION BY replicate, model ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
ap AS (SELECT replicate, model, sum(pos*tp/m::double)/sum(pos) AS ap FROM r GROUP BY 1, 2),
d AS (SELECT a.ap AS ap_a, b.ap AS ap_b, a.ap-b.ap AS diff FROM ap a JOIN ap b USING (replicate)
  WHERE a.model='a' AND b.model='b')
SELECT """ + ", ".join(
    f"round(avg({c}), 6) AS {c}_mean, round(quantile_cont({c}, 0.025), 6) AS {c}_low, "
    f"round(quantile_cont({c}, 0.975), 6) AS {c}_high" for c in ("ap_a", "ap_b", "diff")) + " FROM d")
def bootstrap_ap_ci(spark, sf_dir):
    p = predictions(spark, sf_dir).withColumnRenamed("y", "y_true")
    return M.bootstrap_ap_ci(p)
