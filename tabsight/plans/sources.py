"""Source, sink and prediction-table queries. Files are written from the given tables first."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsight.operators.splits import spotlight_ids
from tabsight.plans.registry import query
from tabsight.plans.views import PRED, PRED_LONG, predictions, predictions_long, table, with_views
from tabsight.sources import files as S
from tabsight.sources import predictions as P


@query("read_delimited", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def read_delimited(spark, sf_dir):
    path = S.shared_folder(spark)
    c = table(spark, sf_dir, "customer")
    S.write_delimited(c.toDF(*[f" {n.upper()} " for n in c.columns]), path, ";")
    return S.read_delimited(spark, path, T.StructType([T.StructField(f.name, f.dataType) for f in c.schema.fields]))


@query("partitioned_predictions", with_views(PRED_LONG) + """
SELECT id, y_true, y_pred, model, fold FROM v_long WHERE model='a' AND fold IN (1, 2)""")
def partitioned_predictions(spark, sf_dir):
    path = S.shared_folder(spark)
    S.write_table(predictions_long(spark, sf_dir), path, partition_by=["model", "fold"])
    return spark.read.parquet(path).filter("model = 'a' AND fold IN (1, 2)")


@query("json_roundtrip", "SELECT p_partkey, p_name, p_retailprice FROM part")
def json_roundtrip(spark, sf_dir):
    path = S.shared_folder(spark)
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice")
    S.write_table(p, path, "json")
    return spark.read.schema(p.schema).json(path)


@query("pred_normalise", with_views(PRED) + """
SELECT id, -1 AS fold, 'raw' AS model, CASE WHEN id%13=0 THEN 0 ELSE y END AS y_true,
  round(CASE WHEN id%11=0 THEN 0.5 ELSE greatest(least(p_a*1.4-0.2, 1), 0) END::double, 6) AS y_pred FROM v_pred""")
def pred_normalise(spark, sf_dir):
    p = predictions(spark, sf_dir)
    raw = p.select(F.col("id").alias("sample_id"), F.when(F.col("id") % 13 != 0, F.col("y")).alias("target"),
                   F.when(F.col("id") % 11 != 0, F.col("p_a") * 1.4 - 0.2).alias("prob"))
    return P.normalise_predictions(raw, key="sample_id", model="raw")


SOURCES = PRED_LONG + """, v_src AS (SELECT *, 'ensemble' AS source FROM v_long
  UNION ALL SELECT id, fold, model, y_true, y_pred*0.9, 'root' FROM v_long WHERE id%2=0
  UNION ALL SELECT id, fold, model, y_true, y_pred*0.8, 'final' FROM v_long WHERE id%3=0)
"""


@query("pred_prefer_source", with_views(SOURCES) + """
SELECT id, fold, model, y_true, round(y_pred::double, 6) AS y_pred, source FROM (SELECT *, row_number() OVER
  (PARTITION BY model, id ORDER BY CASE source WHEN 'final' THEN 1 WHEN 'root' THEN 2 ELSE 3 END) AS k FROM v_src)
WHERE k=1""")
def pred_prefer_source(spark, sf_dir):
    p = predictions_long(spark, sf_dir)

    def scaled(rows, factor: float, name: str):
        return rows.withColumns({"y_pred": F.col("y_pred") * factor, "source": F.lit(name)})

    every = (scaled(p, 1.0, "ensemble").unionByName(scaled(p.filter("id % 2 = 0"), 0.9, "root"))
             .unionByName(scaled(p.filter("id % 3 = 0"), 0.8, "final")))
    return P.prefer_source(every, ["final", "root", "ensemble"])


@query("oof_manifest", with_views(PRED_LONG) + """
SELECT model, count(*) AS rows, 5 AS columns, round(avg(y_true), 6) AS positive_ratio, count(DISTINCT id) AS ids,
  string_agg(DISTINCT cast(fold AS varchar), ',' ORDER BY cast(fold AS varchar)) AS folds FROM v_long GROUP BY 1""")
def oof_manifest(spark, sf_dir):
    return P.prediction_manifest(predictions_long(spark, sf_dir))


@query("spotlight_listed", with_views(PRED) + """
SELECT id, y, p_a FROM v_pred WHERE id%7=0 AND id%21<>0""")
def spotlight_listed(spark, sf_dir):
    """Ids read from text lines: padded numbers count, anything else is skipped."""
    path = S.shared_folder(spark)
    ids = table(spark, sf_dir, "orders").filter("o_orderkey % 7 = 0")
    k = F.col("o_orderkey").cast("string")
    ids.select(F.when(F.col("o_orderkey") % 21 == 0, F.concat(F.lit("#"), k)).otherwise(
        F.concat(F.lit("  "), k, F.lit(" "))).alias("value")).write.text(path)
    return spotlight_ids(predictions(spark, sf_dir).select("id", "y", "p_a"), "id", S.read_id_list(spark, path))
