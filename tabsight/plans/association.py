"""Feature association, selection and shift queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsight.operators import association as A
from tabsight.operators.splits import stratified_split
from tabsight.plans.registry import query
from tabsight.plans.splits import SQL_PLACED
from tabsight.plans.views import MEASURE, MEASURE_KEYS, TEXT_LABEL, measure, text_labels, with_views
from tabsight.sources.files import materialised

KEYS = ", ".join(MEASURE_KEYS)
FEATURES = ["l_quantity", "l_extendedprice", "hi", "lo", "total", "large", "big"]
BINARY = ["large", "big"]


def features(spark, sf_dir) -> DataFrame:
    return measure(spark, sf_dir).withColumns({
        "total": F.col("hi") + F.col("lo"), "large": (F.col("l_quantity") > 25).cast("int"),
        "big": (F.col("l_quantity") > 26).cast("int")})


FEAT = MEASURE + """, v_feat AS (SELECT *, hi+lo AS total, (l_quantity>25)::int AS large, (l_quantity>26)::int AS big
  FROM v_measure)
"""


def sql_matrix(columns: list[str], src: str, value: str) -> str:
    """All ordered pairs as a CTE ``mat`` (a, b, r)."""
    one = ", ".join(f"corr({value.format(a)}, {value.format(b)}) AS r_{i}_{j}" for i, a in enumerate(columns)
                    for j, b in enumerate(columns) if i < j)
    rows = " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, {'1.0::double' if i == j else f'r_{min(i, j)}_{max(i, j)}'} AS r FROM one"
        for i, a in enumerate(columns) for j, b in enumerate(columns))
    return f"one AS (SELECT {one} FROM {src}), mat AS ({rows})"


def sql_ranks(columns: list[str]) -> str:
    return "rks AS (SELECT " + ", ".join(
        f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1)/2.0::double AS k_{c}"
        for c in columns) + " FROM v_feat)"


SPEARMAN = sql_ranks(FEATURES) + ", " + sql_matrix(FEATURES, "rks", "k_{}")


@query("corr_pearson", with_views(FEAT, sql_matrix(FEATURES + ["target"], "v_feat", "{}::double")) + """
SELECT a, b, round(r, 6) AS r FROM mat""")
def corr_pearson(spark, sf_dir):
    return A.corr_pearson(features(spark, sf_dir), FEATURES + ["target"])


@query("corr_spearman", with_views(FEAT, SPEARMAN) + "SELECT a, b, round(abs(r), 6) AS r FROM mat")
def corr_spearman(spark, sf_dir):
    return A.corr_spearman(features(spark, sf_dir), FEATURES)


@query("corr_edges", with_views(FEAT, sql_matrix(FEATURES, "v_feat", "{}::double")) + f"""
SELECT a, b, round(r, 6) AS r FROM mat WHERE list_position({FEATURES}, a) < list_position({FEATURES}, b)
AND abs(r)>0.3""")
def corr_edges(spark, sf_dir):
    return A.corr_edges(features(spark, sf_dir), FEATURES)


def _sql_code(c: str) -> str:
    if c not in ("l_quantity", "l_extendedprice", "total"):
        return f"{c}::double"
    cuts = "[" + ", ".join(f"{i}/16.0" for i in range(1, 16)) + "]"
    return f"len(list_filter((SELECT quantile_cont({c}::double, {cuts}) FROM v_feat), lambda v: {c}>v))::double"


SQL_MI = "cells AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", {_sql_code(c)} AS bin, target AS y FROM v_feat" for c in FEATURES) + """),
joint AS (SELECT "column", bin, y, count(*)::double AS m FROM cells GROUP BY ALL),
mi AS (SELECT "column", sum(m/n*ln(m*n/(mx*my))) AS mutual_info FROM (SELECT *,
  sum(m) OVER (PARTITION BY "column", bin) AS mx, sum(m) OVER (PARTITION BY "column", y) AS my,
  sum(m) OVER (PARTITION BY "column") AS n FROM joint) GROUP BY 1)"""


@query("mutual_information", with_views(FEAT, SQL_MI) + """
SELECT "column", round(mutual_info, 6) AS mutual_info FROM mi""")
def mutual_information(spark, sf_dir):
    return A.mutual_information(features(spark, sf_dir), FEATURES, "target")


def sql_auc(columns: list[str], src: str, target: str) -> str:
    """AUC and distinct count per column as a CTE ``auc``."""
    long = " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", {c}::double AS v, ({target})::int AS y FROM {src}" for c in columns)
    return f"""acnt AS (SELECT "column", v, sum(y) AS pos, count(*) AS n FROM ({long}) GROUP BY ALL),
arun AS (SELECT *, sum(n-pos) OVER (PARTITION BY "column" ORDER BY v ROWS UNBOUNDED PRECEDING) AS below FROM acnt),
auc AS (SELECT "column", count(*) AS "distinct",
  sum(pos*(below-(n-pos)+0.5*(n-pos)))/(sum(pos)*sum(n-pos))::double AS auc FROM arun GROUP BY 1)"""


@query("mutual_information_knn")
def mutual_information_knn(spark, sf_dir):
    return A.mutual_information_knn(features(spark, sf_dir), FEATURES, "target")


@query("univariate_auc", with_views(FEAT, sql_auc(FEATURES, "v_feat", "target")) + """
SELECT "column", round(auc, 6) AS auc, "distinct" FROM auc""")
def univariate_auc(spark, sf_dir):
    return A.univariate_auc(features(spark, sf_dir), FEATURES, "target")


@query("text_feature_auc", with_views(TEXT_LABEL, sql_auc(["score", "n_chars"], "v_text", "y")) + """
SELECT "column", round(auc, 6) AS auc, "distinct" FROM auc""")
def text_feature_auc(spark, sf_dir):
    return A.univariate_auc(text_labels(spark, sf_dir), ["score", "n_chars"], "y")


def _stat(c: str) -> str:
    return f"""SELECT '{c}' AS "column", var_samp({c}) AS variance, {'true' if c in BINARY else 'false'} AS is_binary,
      count(*) AS rows FROM v_feat"""


@query("feature_audit", with_views(FEAT, SQL_MI, sql_auc(FEATURES, "v_feat", "target")) + f"""
SELECT "column", round(mutual_info, 6) AS mutual_info, round(auc, 6) AS auc, round(variance, 2) AS variance, is_binary,
  "distinct", "distinct"<=1 AS constant, "distinct"<=greatest(2, floor(rows*0.001)) AS near_constant,
  "distinct">greatest(2, floor(rows*0.001)) AND "column" NOT IN ('big') AS selected
FROM ({' UNION ALL '.join(_stat(c) for c in FEATURES)}) JOIN mi USING ("column") JOIN auc USING ("column")""")
def feature_audit(spark, sf_dir):
    audit = A.feature_audit(features(spark, sf_dir), FEATURES, "target", drop=["big"])
    return audit.withColumn("variance", F.round("variance", 2))


@query("redundant_features")
def redundant_features(spark, sf_dir):
    return A.redundant_features(features(spark, sf_dir), FEATURES, "target")


@query("prune_correlated", with_views(FEAT, sql_matrix(FEATURES + ["target"], "v_feat", "{}::double")) + f""",
worth AS (SELECT a AS c, abs(r) AS v FROM mat WHERE b='target'),
pr AS (SELECT m.a, m.b, x.v AS va, y.v AS vb FROM mat m JOIN worth x ON m.a=x.c JOIN worth y ON m.b=y.c
  WHERE m.a<>'target' AND list_position({FEATURES}, m.a) < list_position({FEATURES}, m.b) AND abs(m.r)>0.6)
SELECT DISTINCT CASE WHEN a='big' THEN a WHEN b='big' THEN b WHEN va<vb THEN a ELSE b END AS dropped FROM pr""")
def prune_correlated(spark, sf_dir):
    return A.prune_correlated(features(spark, sf_dir), FEATURES, "target", threshold=0.6, drop_first=["big"])


@query("binary_duplicates", with_views(FEAT, SPEARMAN) + """
SELECT a AS "column", round(max(abs(r)), 6) AS max_r FROM mat WHERE a<>b AND a IN ('large', 'big')
GROUP BY 1 HAVING max(abs(r))>0.95""")
def binary_duplicates(spark, sf_dir):
    return A.binary_duplicates(features(spark, sf_dir), FEATURES)


def _bin(c: str, shown: str) -> str:
    return f"""'{shown}_Q'||greatest(1, ((row_number() OVER (ORDER BY {c}, u, {KEYS})-1)*4+n-2)//(n-1)) AS {shown}"""


@query("quantile_bins", with_views(MEASURE) + f""",
h AS (SELECT *, ('0x'||substr(md5(concat_ws(':', 'ties', {KEYS})), 1, 13))::bigint AS u, count(*) OVER () AS n
  FROM v_measure)
SELECT {KEYS}, {_bin('l_quantity', 'amount')}, {_bin('hi', 'hi')}, {_bin('l_extendedprice', 'l_extendedprice')} FROM h""")
def quantile_bins(spark, sf_dir):
    return A.quantile_bins(measure(spark, sf_dir), ["l_quantity", "hi", "l_extendedprice"], MEASURE_KEYS,
                           names={"l_quantity": "amount"})


SHIFT_CASE = """CASE WHEN auc<=0.55 THEN 'None' WHEN auc<=0.6 THEN 'Low' WHEN auc<=0.7 THEN 'Medium' ELSE 'High' END"""


@query("shift_univariate", with_views(FEAT) + f""",
shift AS (SELECT *, l_linenumber>3 AND hi>2 AS part FROM v_feat),
{sql_auc(FEATURES, 'shift', 'part')}
SELECT "column", round(auc, 6) AS auc, {SHIFT_CASE} AS severity FROM auc""")
def shift_univariate(spark, sf_dir):
    f = features(spark, sf_dir).withColumn("part", ((F.col("l_linenumber") > 3) & (F.col("hi") > 2)).cast("int"))
    return A.shift_univariate(f, FEATURES, "part")


# the split is read off the placed rows themselves: a join on the keys would repeat rows that share them
@query("shift_split_check", with_views(SQL_PLACED, "part AS (SELECT *, hi+lo AS total, (l_quantity>25)::int AS large, "
                                       "(l_quantity>26)::int AS big, rn<=round(n*0.2::double) AS part FROM v_placed)",
                                       sql_auc(FEATURES, "part", "part")) + f"""
SELECT "column", round(auc, 6) AS auc, {SHIFT_CASE} AS severity FROM auc""")
def shift_split_check(spark, sf_dir):
    s = stratified_split(features(spark, sf_dir), "target", MEASURE_KEYS)
    return A.shift_univariate(s.withColumn("part", (F.col("split") == "test").cast("int")), FEATURES, "part")


@query("shift_classifier")
def shift_classifier(spark, sf_dir):
    s = stratified_split(features(spark, sf_dir), "target", MEASURE_KEYS)
    part = materialised(s.withColumn("part", (F.col("split") == "test").cast("int")))
    cols = ["l_quantity", "l_extendedprice", "hi", "lo"]
    return (A.shift_classifier(part, cols, "part", MEASURE_KEYS)
            .unionByName(A.shift_classifier(part, cols, "part", MEASURE_KEYS, model="logistic")))
