"""Demo inputs derived from the star-schema tables, once for Spark and once as SQL text.

Each SQL constant is a list of CTE definitions without the leading WITH; ``with_views`` joins them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsight.functions.expressions import hash32

MEASURE_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def with_views(*ctes: str) -> str:
    return "WITH " + ", ".join(c.strip() for c in ctes) + "\n"


def sql_hash(seed: str, key: str, word: str = "0") -> str:
    return (f"('0x'||substr(md5(concat('{seed}:',cast({key} as varchar))),(({word})*8+1)::bigint,8))::bigint")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def measure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        *MEASURE_KEYS, "l_quantity", "l_extendedprice",
        F.round(F.col("l_discount") * 100).cast("int").alias("hi"),
        F.round(F.col("l_tax") * 100).cast("int").alias("lo"),
        "l_linestatus",
        (F.col("l_returnflag") == "R").cast("int").alias("target"))


MEASURE = """
v_measure AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
  cast(round(l_discount*100) as int) AS hi, cast(round(l_tax*100) as int) AS lo, l_linestatus,
  cast(l_returnflag='R' as int) AS target FROM lineitem)
"""


def measure_signed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``measure`` with the high column shifted down by one, so that negatives occur."""
    return measure(spark, sf_dir).withColumn("hi", F.col("hi") - 1)


MEASURE_SIGNED = MEASURE + ", v_signed AS (SELECT * REPLACE (hi-1 AS hi) FROM v_measure)"


def measure_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure(spark, sf_dir).withColumns({
        "l_quantity": F.when(F.col("l_orderkey") % 17 != 0, F.col("l_quantity")),
        "l_linestatus": F.when(F.col("l_partkey") % 13 != 0, F.col("l_linestatus"))})


MEASURE_NULL = MEASURE + """, v_null AS (SELECT * REPLACE (
  CASE WHEN l_orderkey%17<>0 THEN l_quantity END AS l_quantity,
  CASE WHEN l_partkey%13<>0 THEN l_linestatus END AS l_linestatus) FROM v_measure)
"""


def measure_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = measure(spark, sf_dir)
    return m.unionAll(m.filter(F.col("l_orderkey") % 101 == 0))


MEASURE_DUP = MEASURE + """, v_dup AS (SELECT * FROM v_measure
  UNION ALL SELECT * FROM v_measure WHERE l_orderkey%101=0)
"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two scored models per order, an outcome and a fold: ``id, fold, y, p_a, p_b``."""
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    noise = {s: hash32(s, "o_orderkey") for s in ("y", "a", "b", "fold")}
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", cents.alias("c"), (noise["y"] % 50_000_000).alias("ny"),
        (noise["a"] % 50_000_000).alias("na"), (noise["b"] % 50_000_000).alias("nb"),
        (noise["fold"] % 5).alias("nf"))

    def score(a: int, b: int, n: str):
        step = F.floor((F.col("c") * a + F.col(n) * b) / 500_000)
        return ((F.least(step, F.lit(999)) + F.lit(0.5)) / 1000).cast("double")

    return o.select(
        F.col("o_orderkey").alias("id"), F.col("nf").cast("int").alias("fold"),
        (F.col("c") + F.col("ny") > 50_000_000).cast("int").alias("y"),
        score(7, 3, "na").alias("p_a"), score(5, 5, "nb").alias("p_b"))


PRED = f"""
v_pred0 AS (SELECT o_orderkey, cast(round(o_totalprice*100) as bigint) AS c FROM orders),
v_pred AS (SELECT o_orderkey AS id, ({sql_hash('fold', 'o_orderkey')} % 5)::int AS fold,
  cast(c + {sql_hash('y', 'o_orderkey')} % 50000000 > 50000000 as int) AS y,
  ((least(floor((c*7 + ({sql_hash('a', 'o_orderkey')} % 50000000)*3)/500000), 999)+0.5)/1000)::double AS p_a,
  ((least(floor((c*5 + ({sql_hash('b', 'o_orderkey')} % 50000000)*5)/500000), 999)+0.5)/1000)::double AS p_b
  FROM v_pred0)
"""


def predictions_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, fold, model, y_true, y_pred``, one row per id and model."""
    p = predictions(spark, sf_dir)
    return p.select("id", "fold", F.inline(F.array(
        *[F.struct(F.lit(m).alias("model"), F.col("y").alias("y_true"), F.col(f"p_{m}").alias("y_pred"))
          for m in ("a", "b")])))


PRED_LONG = PRED + """, v_long AS (
  SELECT id, fold, 'a' AS model, y AS y_true, p_a AS y_pred FROM v_pred
  UNION ALL SELECT id, fold, 'b', y, p_b FROM v_pred)
"""


def attributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedding elements read as a (feature, step) score matrix per row, in long form."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id").alias("id"), (F.col("vec_id") % 5).cast("int").alias("fold"),
        F.col("label").alias("cohort"), (F.col("label") >= 5).cast("int").alias("target"),
        F.posexplode("embedding").alias("pos", "e")).select(
        "id", "fold", "cohort", "target",
        F.concat(F.lit("f"), (F.col("pos") % 16).cast("string")).alias("feature"),
        F.floor(F.col("pos") / 16).cast("int").alias("step"),
        F.abs(F.col("e").cast("double")).alias("score"))


ATTR = """
v_attr AS (SELECT vec_id AS id, (vec_id%5)::int AS fold, label AS cohort, cast(label>=5 as int) AS target,
  'f'||cast(pos%16 as varchar) AS feature, (pos//16)::int AS step, abs(e::double) AS score
  FROM (SELECT vec_id, label, unnest(range(0, len(embedding))) AS pos, unnest(embedding) AS e FROM embeddings))
"""


def baskets(spark: SparkSession, sf_dir: str, at_least: int = 15) -> DataFrame:
    """``user_id, cohort, item``: event types a user fired at least ``at_least`` times."""
    return (table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("m"))
            .filter(F.col("m") >= at_least)
            .select("user_id", (F.col("user_id") % 3).cast("int").alias("cohort"),
                    F.col("event_type").alias("item")))


BASKET = """
v_basket AS (SELECT user_id, (user_id%3)::int AS cohort, event_type AS item FROM events
  GROUP BY user_id, event_type HAVING count(*) >= 15)
"""


def family(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored orders with their customer key: ``id, y, p_a, o_custkey``."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey")
    return predictions(spark, sf_dir).select("id", "y", "p_a").join(o, "id")


def customer_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer columns for six of seven customers, so that some lookups find nothing."""
    return (table(spark, sf_dir, "customer").filter(F.col("c_custkey") % 7 != 0)
            .select(F.col("c_custkey").alias("o_custkey"), "c_acctbal", "c_mktsegment"))


FAMILY = PRED + """, v_family AS (SELECT p.id, p.y, p.p_a, o.o_custkey, c.c_acctbal, c.c_mktsegment
  FROM v_pred p JOIN orders o ON p.id=o.o_orderkey
  LEFT JOIN (SELECT * FROM customer WHERE c_custkey%7<>0) c ON o.o_custkey=c.c_custkey)
"""


def text_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    top = d.agg(F.max("n_chars").alias("m")).first()["m"]
    return (table(spark, sf_dir, "labels").join(d, "doc_id")
            .select("doc_id", F.col("quality").alias("y"),
                    (F.col("n_chars") / F.lit(float(top))).alias("score"), "n_chars"))


TEXT_LABEL = """
v_text AS (SELECT doc_id, quality AS y, n_chars::double/(SELECT max(n_chars) FROM documents) AS score, n_chars
  FROM labels JOIN documents USING (doc_id))
"""


STEP_FEATURES = [f"f{i}" for i in range(16)]


def attribution_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``attributions`` with one (features x steps) matrix per row instead of one row per cell."""
    e = table(spark, sf_dir, "embeddings")
    steps = F.sequence(F.lit(0), F.floor(F.size("embedding") / 16).cast("int") - 1)
    cells = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda f: F.transform(
        steps, lambda s: F.abs(F.get("embedding", s * 16 + f).cast("double"))))
    return e.select(F.col("vec_id").alias("id"), (F.col("vec_id") % 5).cast("int").alias("fold"),
                    F.col("label").alias("cohort"), (F.col("label") >= 5).cast("int").alias("target"),
                    cells.alias("matrix"))
