"""Itemset and association-rule queries. Item lists are shown as comma-joined text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsight.operators import itemsets as S
from tabsight.operators import rules as R
from tabsight.plans.attribution import MEANS, step_means
from tabsight.plans.registry import query
from tabsight.plans.splits import sql_cell_draws
from tabsight.plans.views import BASKET, baskets, table, with_views

SUPPORT, CONFIDENCE, LIFT, LEN = 0.02, 0.5, 1.0, 4

NORM = MEANS + """, v_norm AS (SELECT *, score/CASE WHEN max(score) OVER f=0 THEN 1 ELSE max(score) OVER f END AS norm
  FROM v_mean WINDOW f AS (PARTITION BY feature))
"""
ACTIVE = NORM + """, v_bin AS (SELECT n.*, (norm>=cut)::int AS active FROM v_norm n JOIN
  (SELECT feature, quantile_cont(norm, 0.8) AS cut FROM v_norm GROUP BY 1) c USING (feature))
"""
ITEMS = ACTIVE + """, v_min AS (SELECT * REPLACE (CASE WHEN sum(active) OVER (PARTITION BY id)<2 AND row_number() OVER
  (PARTITION BY id ORDER BY score DESC, feature)<=2 THEN 1 ELSE active END AS active) FROM v_bin),
v_base AS (SELECT id, any_value(fold) AS fold, any_value(cohort) AS cohort, any_value(target) AS target FROM v_min GROUP BY 1),
v_items AS (SELECT id, cohort, feature AS item FROM v_min WHERE active=1
  UNION ALL SELECT id, cohort, 'target' FROM v_base WHERE target=1)
"""


def normalised(spark, sf_dir) -> DataFrame:
    return S.score_normalise(step_means(spark, sf_dir), "max")


def active(spark, sf_dir) -> DataFrame:
    return S.min_active_items(S.binarize_scores(normalised(spark, sf_dir), "p80"), 2)


def basket_table(spark, sf_dir) -> DataFrame:
    labels = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), (F.col("vec_id") % 5).cast("int").alias("fold"), F.col("label").alias("cohort"),
        (F.col("label") >= 5).cast("int").alias("target"))
    return S.itemset_table(active(spark, sf_dir), labels)


def text(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.concat_ws(",", c) for c in columns})


@query("score_normalise", with_views(NORM) + """
SELECT id, feature, round(norm, 6) AS norm, round((score-avg(score) OVER g)/stddev_pop(score) OVER g, 6) AS zscore
FROM v_norm WINDOW g AS (PARTITION BY feature)""")
def score_normalise(spark, sf_dir):
    z = S.score_normalise(normalised(spark, sf_dir), "zscore", out="zscore")
    return z.select("id", "feature", "norm", "zscore")


@query("binarize_scores", with_views(ACTIVE) + "SELECT id, feature, active FROM v_bin")
def binarize_scores(spark, sf_dir):
    return S.binarize_scores(normalised(spark, sf_dir), "p80").select("id", "feature", "active")


@query("binarize_fixed", with_views(NORM) + "SELECT id, feature, (norm>=0.5)::int AS active FROM v_norm")
def binarize_fixed(spark, sf_dir):
    return S.binarize_scores(normalised(spark, sf_dir), 0.5).select("id", "feature", "active")


@query("min_active_items", with_views(ITEMS) + "SELECT id, feature, active FROM v_min")
def min_active_items(spark, sf_dir):
    return active(spark, sf_dir).select("id", "feature", "active")


@query("itemset_table", with_views(ITEMS) + """
SELECT b.id, fold, b.cohort, target, coalesce(string_agg(item, ',' ORDER BY item), '') AS items
FROM v_base b LEFT JOIN v_items i ON b.id=i.id GROUP BY ALL""")
def itemset_table(spark, sf_dir):
    return text(basket_table(spark, sf_dir), "items")


@query("itemset_quality", with_views(ITEMS) + """
SELECT count(*) AS rows, count(*) FILTER (target=1) AS positive, count(*) FILTER (target=0) AS negative, 0::bigint AS missing,
  min(k)::int AS min_items, max(k)::int AS max_items, round(avg(k), 6) AS mean_items FROM v_base
JOIN (SELECT id, count(*) AS k FROM v_items GROUP BY 1) USING (id)""")
def itemset_quality(spark, sf_dir):
    return S.itemset_quality(basket_table(spark, sf_dir), target="target")


def sql_sets(src: str, rows: str, by: str = "", key: str = "id", support: float = SUPPORT, size: int = LEN) -> str:
    """Frequent itemsets up to ``size`` items as a CTE ``freq`` (by, items, k, count, rows, support), by self-joins.

    ``src`` holds (key, by, item); ``rows`` is a subquery with the row count ``rows`` per group.
    """
    g = f"{by}, " if by else ""
    on = f" USING ({by})" if by else ""
    one = f"SELECT {g}x.item AS items, 1 AS k, count(*) AS count FROM {src} x GROUP BY ALL"
    p = f"x.{by}, " if by else ""
    parts = [one]
    for k in range(2, size + 1):
        names = "xyzuvw"[:k]
        joins = "".join(f" JOIN {src} {n} ON x.{key}={n}.{key} AND {m}.item<{n}.item" for m, n in zip(names, names[1:]))
        items = "||','||".join(f"{n}.item" for n in names)
        parts.append(f"SELECT {p}{items} AS items, {k} AS k, count(*) AS count FROM {src} x{joins} GROUP BY ALL")
    join = f"JOIN ({rows}) t{on}" if by else f"CROSS JOIN ({rows}) t"
    return f"""freq AS (SELECT {g}items, k, count, rows, count/rows::double AS support
  FROM ({' UNION ALL '.join(parts)}) {join} WHERE count/rows::double >= {support})"""


FREQ = sql_sets("v_items", "SELECT count(*) AS rows FROM v_base")


def frequent(spark, sf_dir) -> DataFrame:
    return S.frequent_itemsets(basket_table(spark, sf_dir), min_support=SUPPORT, max_len=LEN)


@query("frequent_itemsets", with_views(ITEMS, FREQ) + "SELECT items, count::bigint AS count, rows, round(support, 6) AS support FROM freq")
def frequent_itemsets(spark, sf_dir):
    return text(frequent(spark, sf_dir), "items")


EVENT_FREQ = sql_sets("v_basket", "SELECT count(DISTINCT user_id) AS rows FROM events", key="user_id", support=0.005)


def event_baskets(spark, sf_dir) -> DataFrame:
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    held = baskets(spark, sf_dir).groupBy("user_id").agg(F.collect_list("item").alias("items"))
    return users.join(held, "user_id", "left").select(
        "user_id", (F.col("user_id") % 3).cast("int").alias("cohort"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"))


@query("event_itemsets", with_views(BASKET, EVENT_FREQ) + """
SELECT items, count::bigint AS count, rows, round(support, 6) AS support FROM freq""")
def event_itemsets(spark, sf_dir):
    return text(S.frequent_itemsets(event_baskets(spark, sf_dir), min_support=0.005, max_len=LEN), "items")


def sql_rules(by: str = "", confidence: float = CONFIDENCE) -> str:
    """Rules with consequent {target} as a CTE ``rules``; ``freq`` must exist."""
    g, j = (f"f.{by}, ", f" AND {{}}.{by}=f.{by}") if by else ("", "")
    return f"""split AS (SELECT f.*, list_filter(string_split(items, ','), lambda v: v<>'target') AS l FROM freq f
  WHERE k>1 AND list_contains(string_split(items, ','), 'target')),
rules AS (SELECT {g}array_to_string(f.l, ',') AS antecedents, 'target' AS consequents, a.support AS antecedent_support,
  c.support AS consequent_support, f.support AS support, f.support/a.support AS confidence,
  f.support/a.support/c.support AS lift, f.l FROM split f JOIN freq a ON a.items=array_to_string(f.l, ','){j.format('a')}
  JOIN freq c ON c.items='target'{j.format('c')} WHERE f.support/a.support >= {confidence})"""


RULES = sql_rules()
SHOW = """antecedents, consequents, round(antecedent_support, 6) AS antecedent_support,
  round(consequent_support, 6) AS consequent_support, round(support, 6) AS support, round(confidence, 6) AS confidence,
  round(lift, 6) AS lift"""


def mined(spark, sf_dir) -> DataFrame:
    return R.target_rules(frequent(spark, sf_dir), "target", CONFIDENCE)


def shown(rules: DataFrame) -> DataFrame:
    return text(rules, "antecedents", "consequents")


@query("target_rules", with_views(ITEMS, FREQ, RULES) + f"SELECT {SHOW} FROM rules")
def target_rules(spark, sf_dir):
    return shown(mined(spark, sf_dir))


@query("general_rules", with_views(BASKET, EVENT_FREQ) + f""",
sp AS (SELECT string_split(items, ',') AS l, support, unnest(range(1, (1<<k)-1)) AS m FROM freq WHERE k>1),
sd AS (SELECT support, array_to_string([l[i] for i in range(1, len(l)+1) if (m>>(i-1))&1=1], ',') AS antecedents,
  array_to_string([l[i] for i in range(1, len(l)+1) if (m>>(i-1))&1=0], ',') AS consequents FROM sp),
rules AS (SELECT antecedents, consequents, a.support AS antecedent_support, c.support AS consequent_support,
  sd.support AS support, sd.support/a.support AS confidence, sd.support/a.support/c.support AS lift FROM sd
  JOIN freq a ON a.items=antecedents JOIN freq c ON c.items=consequents)
SELECT {SHOW} FROM rules WHERE lift>=0.8""")
def general_rules(spark, sf_dir):
    freq = S.frequent_itemsets(event_baskets(spark, sf_dir), min_support=0.005, max_len=LEN)
    return shown(R.general_rules(freq, metric="lift", min_threshold=0.8))


@query("rule_metrics", with_views(ITEMS, FREQ, RULES) + """,
m AS (SELECT *, support-antecedent_support*consequent_support AS leverage FROM rules)
SELECT antecedents, round(leverage, 6) AS leverage,
  round(CASE WHEN confidence<1 THEN (1-consequent_support)/(1-confidence) END, 6) AS conviction,
  round(leverage/greatest(support*(1-antecedent_support), antecedent_support*(consequent_support-support)), 6) AS zhangs_metric,
  round(support/(antecedent_support+consequent_support-support), 6) AS jaccard,
  round((confidence-consequent_support)/(1-consequent_support), 6) AS certainty,
  round((confidence+support/consequent_support)/2, 6) AS kulczynski, 1.0::double AS representativity FROM m""")
def rule_metrics(spark, sf_dir):
    return text(R.rule_metrics(mined(spark, sf_dir)), "antecedents").drop(
        "consequents", "antecedent_support", "consequent_support", "support", "confidence", "lift")


COHORT_FREQ = ("v_big AS (SELECT * FROM v_items WHERE cohort IN (SELECT cohort FROM v_base GROUP BY 1 HAVING count(*)>=45)), "
               + sql_sets("v_big", "SELECT cohort, count(*) AS rows FROM v_base GROUP BY 1", by="cohort", support=0.05))


def cohort_mined(spark, sf_dir) -> DataFrame:
    big = R.large_groups(basket_table(spark, sf_dir), ["cohort"], 45)
    freq = S.frequent_itemsets(big, by=["cohort"], min_support=0.05, max_len=LEN)
    return R.target_rules(freq, "target", CONFIDENCE, by=["cohort"])


@query("cohort_rules", with_views(ITEMS, COHORT_FREQ, sql_rules("cohort")) + f"SELECT cohort, {SHOW} FROM rules")
def cohort_rules(spark, sf_dir):
    return shown(cohort_mined(spark, sf_dir))


KEPT = """kept AS (SELECT * FROM rules WHERE support>=0.022 AND confidence>=0.55 AND lift>=1.05)"""


def kept(spark, sf_dir) -> DataFrame:
    return R.filter_rules(mined(spark, sf_dir), min_support=0.022, min_confidence=0.55, min_lift=1.05)


@query("filter_rules", with_views(ITEMS, FREQ, RULES, KEPT) + f"SELECT {SHOW} FROM kept")
def filter_rules(spark, sf_dir):
    return shown(kept(spark, sf_dir))


PRUNED = """pruned AS (SELECT * FROM rules r WHERE NOT EXISTS (SELECT 1 FROM rules s WHERE len(s.l)<len(r.l)
  AND list_has_all(r.l, s.l) AND s.lift+1e-9>=r.lift AND s.confidence+1e-9>=r.confidence AND s.support+1e-9>=r.support))"""


@query("prune_rules", with_views(ITEMS, FREQ, RULES, PRUNED) + f"SELECT {SHOW} FROM pruned")
def prune_rules(spark, sf_dir):
    return shown(R.prune_rules(mined(spark, sf_dir)))


N_BOOT = 200

CELLS = """v_cells AS (SELECT coalesce(string_agg(item, ',' ORDER BY item), '') AS basket, coalesce(list(item) FILTER (item IS NOT NULL), []) AS items
  FROM v_base LEFT JOIN v_items USING (id) GROUP BY id),
v_distinct AS (SELECT basket, any_value(items) AS items, count(*) AS n FROM v_cells GROUP BY basket)"""


@query("rule_stability", with_views(ITEMS, FREQ, RULES, CELLS, sql_cell_draws("v_distinct", "basket", N_BOOT, 0.8, "rules")) + f""",
tot AS (SELECT replicate, sum(w) AS n FROM draws GROUP BY 1),
held AS (SELECT r.antecedents, d.replicate, d.w, list_contains(d.items, 'target')::int AS target FROM rules r JOIN draws d
  ON list_has_all(d.items, r.l)),
c AS (SELECT antecedents, replicate, sum(w) AS a, sum(w*target) AS s FROM held GROUP BY 1, 2),
f AS (SELECT antecedents, count(*) FILTER (s/n::double>={SUPPORT} AND s/a::double>={CONFIDENCE})/{N_BOOT}.0::double AS st
  FROM c JOIN tot USING (replicate) GROUP BY 1)
SELECT r.antecedents, round(lift, 6) AS lift, round(coalesce(st, 0), 6) AS stability FROM rules r LEFT JOIN f
  ON r.antecedents=f.antecedents WHERE coalesce(st, 0)>=0.3""")
def rule_stability(spark, sf_dir):
    out = R.rule_stability(mined(spark, sf_dir), basket_table(spark, sf_dir), target_item="target",
                           min_support=SUPPORT, min_confidence=CONFIDENCE, min_presence=0.3)
    return text(out, "antecedents").select("antecedents", "lift", "stability")


def sql_ranked(src: str, partition: str = "") -> str:
    def part(m: str) -> str:
        return f"greatest(({m}-min({m}) OVER ())/(max({m}) OVER ()-min({m}) OVER ()), 1e-9)"

    return (f"ranked AS (SELECT *, 1.0::double/(0.5/{part('lift')}+0.3/{part('confidence')}+0.2/{part('support')}) "
            f"AS rank_score FROM {src})")


@query("rank_rules", with_views(ITEMS, FREQ, RULES, sql_ranked("rules")) + """
SELECT antecedents, round(rank_score, 6) AS rank_score FROM ranked""")
def rank_rules(spark, sf_dir):
    return text(R.rank_rules(mined(spark, sf_dir)), "antecedents").select("antecedents", "rank_score")


@query("top_rules", with_views(ITEMS, FREQ, RULES, PRUNED, sql_ranked("pruned")) + """
SELECT antecedents, round(lift, 6) AS lift, round(rank_score, 6) AS rank_score FROM ranked
ORDER BY ranked.rank_score DESC, ranked.lift DESC, antecedents LIMIT 10""")
def top_rules(spark, sf_dir):
    top = R.top_rules(R.rank_rules(R.prune_rules(mined(spark, sf_dir))), 10)
    return text(top, "antecedents").select("antecedents", "lift", "rank_score")


@query("top_rules_by_cohort", with_views(ITEMS, COHORT_FREQ, sql_rules("cohort")) + """
SELECT cohort, antecedents, round(lift, 6) AS lift FROM (SELECT *, row_number() OVER (PARTITION BY cohort
  ORDER BY lift DESC, antecedents) AS p FROM rules) WHERE p<=3""")
def top_rules_by_cohort(spark, sf_dir):
    top = R.top_rules(cohort_mined(spark, sf_dir), 3, by=["cohort"])
    return text(top, "antecedents").select("cohort", "antecedents", "lift")


@query("rule_stats", with_views(ITEMS, FREQ, RULES) + """
SELECT count(*) AS rules, round(avg(support), 6) AS mean_support, round(avg(confidence), 6) AS mean_confidence,
  round(avg(lift), 6) AS mean_lift, round(min(lift), 6) AS min_lift, round(max(lift), 6) AS max_lift FROM rules""")
def rule_stats(spark, sf_dir):
    return R.rule_stats(mined(spark, sf_dir))


@query("weakest_rules", with_views(ITEMS, FREQ, RULES) + """
SELECT antecedents, round(confidence, 6) AS confidence, CASE WHEN confidence<0.65 THEN 'check' WHEN confidence<0.7
  THEN 'careful' ELSE 'fair' END AS note FROM rules ORDER BY rules.confidence, antecedents LIMIT 5""")
def weakest_rules(spark, sf_dir):
    return text(R.weakest_rules(mined(spark, sf_dir)), "antecedents").select("antecedents", "confidence", "note")


@query("rule_item_freq", with_views(ITEMS, FREQ, RULES) + """
SELECT item, count(*) AS rules FROM (SELECT unnest(l) AS item FROM rules) GROUP BY 1""")
def rule_item_freq(spark, sf_dir):
    return R.rule_item_freq(mined(spark, sf_dir))


@query("rule_edges", with_views(ITEMS, FREQ, RULES) + """
SELECT item, 'target' AS consequent, round(avg(lift), 6) AS mean_lift, round(avg(confidence), 6) AS mean_confidence,
  count(*) AS rules FROM (SELECT unnest(l) AS item, lift, confidence FROM rules) GROUP BY 1""")
def rule_edges(spark, sf_dir):
    return R.rule_edges(mined(spark, sf_dir))
