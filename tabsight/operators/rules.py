"""Association rules over frequent itemsets: generation, metrics, pruning, stability, ranking.

All inputs here are itemset- or rule-sized; joins are on equal keys (an antecedent, or a set's
rarest item), never on all pairs.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabsight.operators.itemsets import compress_baskets
from tabsight.operators.small import small_side
from tabsight.operators.splits import cell_weights
from tabsight.sources.files import materialised

EPS = 1e-9


def _supports(freq: DataFrame, by: Sequence[str], side: str) -> DataFrame:
    return freq.select(*by, F.col("items").alias(side), F.col("support").alias(f"{side[:-1]}_support"))


def _finish(split: DataFrame, freq: DataFrame, by: Sequence[str]) -> DataFrame:
    """Attach the antecedents' supports and work out confidence and lift."""
    out = split.join(_supports(freq, by, "antecedents"), [*by, "antecedents"])
    return (out.withColumn("confidence", F.col("support") / F.col("antecedent_support"))
            .withColumn("lift", F.col("confidence") / F.col("consequent_support"))
            .select(*by, "antecedents", "consequents", "antecedent_support", "consequent_support", "support",
                    "confidence", "lift"))


def target_rules(freq: DataFrame, target_item: str, min_confidence: float = 0.6, by: Sequence[str] = ()) -> DataFrame:
    """Rules X -> {target} from itemsets that hold the target."""
    alone = freq.filter((F.size("items") == 1) & (F.col("items")[0] == target_item))
    split = freq.filter(F.array_contains("items", target_item) & (F.size("items") > 1)).select(
        *by, F.array_remove("items", target_item).alias("antecedents"),
        F.array(F.lit(target_item)).alias("consequents"), "support")
    if by:
        split = split.join(small_side(alone.select(*by, F.col("support").alias("consequent_support"))), list(by))
    else:
        # one consequent, one number
        row = alone.first()
        split = split.withColumn("consequent_support", F.lit(row["support"] if row else None).cast("double"))
    return _finish(split, freq, by).filter(F.col("confidence") >= min_confidence)


def subset_pairs(sets: DataFrame, subsets: DataFrame, by: Sequence[str], big: str, small: str) -> DataFrame:
    """All pairs of rows of which ``small`` is a non-empty proper subset of ``big``, within ``by``; other columns as they are.

    A subset is met through its rarest item (the one in fewest of the subsets), which its supersets hold too; so
    nobody lists the subsets of a set, however long it is. Both tables have column names of their own.
    """
    counts = small_side(subsets.select(F.explode(small).alias("_item")).groupBy("_item").agg(F.count("*").alias("_n")))
    distinct = subsets.select(small).distinct()
    rarest = (distinct.select(small, F.explode(small).alias("_item")).join(counts, "_item").groupBy(small)
              .agg(F.min(F.struct("_n", "_item"))["_item"].alias("_rare")))
    marked = subsets.join(rarest, small).withColumnsRenamed({k: f"_by_{k}" for k in by})
    match = F.col("_held") == F.col("_rare")
    for k in by:
        match = match & F.col(k).eqNullSafe(F.col(f"_by_{k}"))
    met = sets.select("*", F.explode(big).alias("_held")).join(marked, match)
    return met.filter((F.size(small) < F.size(big)) & (F.size(F.array_except(small, big)) == 0)).drop("_held", "_rare", *[f"_by_{k}" for k in by])


def general_rules(freq: DataFrame, *, metric: str = "lift", min_threshold: float = 1.1,
                  by: Sequence[str] = ()) -> DataFrame:
    """Every antecedent/consequent split of every frequent itemset; the parts of a frequent set are frequent themselves."""
    parts = freq.select(*by, F.col("items").alias("antecedents"), F.col("support").alias("antecedent_support"))
    split = (subset_pairs(freq.filter(F.size("items") > 1).select(*by, "items", "support"), parts, by, "items", "antecedents")
             .select(*by, "antecedents", F.array_except("items", "antecedents").alias("consequents"), "support"))
    split = split.join(_supports(freq, by, "consequents"), [*by, "consequents"])
    return _finish(split, freq, by).filter(F.col(metric) >= min_threshold)


def rule_metrics(rules: DataFrame) -> DataFrame:
    """The further measures of a rule; conviction is NULL (infinite) at confidence 1."""
    a, c, s = F.col("antecedent_support"), F.col("consequent_support"), F.col("support")
    conf, leverage = F.col("confidence"), F.col("leverage")
    return (rules.withColumn("leverage", s - a * c)
            .withColumns({
                "conviction": F.when(conf < 1, (1 - c) / (1 - conf)),
                "zhangs_metric": F.when(F.greatest(s * (1 - a), a * (c - s)) == 0, 0.0).otherwise(
                    leverage / F.greatest(s * (1 - a), a * (c - s))),
                "jaccard": s / (a + c - s),
                "certainty": F.when(c < 1, (conf - c) / (1 - c)).otherwise(0.0),
                "kulczynski": (conf + s / c) / 2,
                "representativity": F.lit(1.0)}))


def large_groups(baskets: DataFrame, by: Sequence[str], min_size: int) -> DataFrame:
    """Baskets of groups with at least ``min_size`` rows; a NULL group is left out."""
    sizes = baskets.groupBy(*by).agg(F.count("*").alias("_size")).filter(F.col("_size") >= min_size)
    return baskets.join(small_side(sizes.select(*by)), list(by))


def filter_rules(rules: DataFrame, *, min_support: float = 0.03, min_confidence: float = 0.6,
                 min_lift: float = 1.2) -> DataFrame:
    return rules.filter((F.col("support") >= min_support) & (F.col("confidence") >= min_confidence)
                        & (F.col("lift") >= min_lift))


def prune_rules(rules: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Drop a rule if one with a subset of its antecedent is at least as good in all three measures.

    Rules meet through their rarest item (``subset_pairs``), so antecedents may be of any length.
    """
    measures = ["lift", "confidence", "support"]
    small = rules.select(*by, F.col("antecedents").alias("_sub"), F.col("consequents").alias("_then"),
                         *[F.col(m).alias(f"_{m}") for m in measures])
    better = F.col("consequents") == F.col("_then")
    for m in measures:
        better = better & (F.col(f"_{m}") + EPS >= F.col(m))
    beaten = subset_pairs(rules.select(*by, "antecedents", "consequents", *measures), small, by, "antecedents", "_sub").filter(better)
    return rules.join(beaten.select(*by, "antecedents", "consequents").distinct(),
                      [*by, "antecedents", "consequents"], "left_anti")


def rule_stability(rules: DataFrame, baskets: DataFrame, *, target_item: str, n_boot: int = 200,
                   sample_frac: float = 0.8, min_support: float = 0.03, min_confidence: float = 0.6,
                   min_presence: float = 0.0, seed: str = "rules") -> DataFrame:
    """Add ``stability``: the share of Poisson resamples in which the rule would be mined again.

    With a fixed consequent this needs three supports per rule and resample, so nothing is mined
    again. Baskets are reduced to distinct ones, each with one draw per resample, before rules are matched, and a
    basket meets a rule through the rule's first item.
    """
    distinct = compress_baskets(baskets.select("items"))
    packed = materialised(cell_weights(distinct.withColumnRenamed("w", "_rows").withColumn("_key", F.concat_ws(",", "items")), ["_key"], "_rows", n_boot, rate=sample_frac, seed=seed))
    hit = F.when(F.array_contains("items", target_item), F.col("w")).otherwise(F.lit(0))
    totals = small_side(packed.groupBy("replicate").agg(F.sum("w").alias("_n")))
    wanted = small_side(rules.select("antecedents", F.col("antecedents")[0].alias("_first")).distinct())
    held = (packed.select("replicate", "w", "items", F.explode("items").alias("_first")).join(wanted, "_first")
            .filter(F.size(F.array_except("antecedents", "items")) == 0)
            .groupBy("replicate", "antecedents").agg(F.sum("w").alias("_a"), F.sum(hit).alias("_s")))
    found = held.join(totals, "replicate").filter(
        (F.col("_s") / F.col("_n") >= min_support) & (F.col("_s") / F.col("_a") >= min_confidence))
    share = found.groupBy("antecedents").agg((F.count("*") / F.lit(float(n_boot))).alias("stability"))
    return (rules.join(share, "antecedents", "left").withColumn("stability", F.coalesce("stability", F.lit(0.0)))
            .filter(F.col("stability") >= min_presence))


# Weights of the ranking measures.
RANK_WEIGHTS = {"lift": 0.5, "confidence": 0.3, "support": 0.2}


def rank_rules(rules: DataFrame, weights: Mapping[str, float] | None = None) -> DataFrame:
    """Add ``rank_score``: weighted harmonic mean of the min-max scaled measures."""
    used = {m: w for m, w in (weights or RANK_WEIGHTS).items() if w > 0 and m in rules.columns}
    if not used:
        return rules.withColumn("rank_score", F.lit(None).cast("double"))
    v = {m: F.coalesce(F.col(m).cast("double"), F.lit(0.0)) for m in used}
    ends = rules.agg(*[f for m in used for f in (F.min(v[m]).alias(f"a_{m}"), F.max(v[m]).alias(f"b_{m}"))]).first()
    inverse = F.lit(0.0)
    for m, w in used.items():
        low, high = ends[f"a_{m}"], ends[f"b_{m}"]
        flat = low is None or abs(high - low) <= 1e-8 + 1e-5 * abs(low)
        scaled = F.lit(1.0) if flat else (v[m] - low) / (high - low)
        inverse = inverse + F.lit(float(w)) / F.greatest(scaled, F.lit(EPS))
    return rules.withColumn("rank_score", F.lit(float(sum(used.values()))) / inverse)


def _order(rules: DataFrame) -> list[Column]:
    first = "rank_score" if "rank_score" in rules.columns else "lift"
    return [F.col(first).desc(), F.col("lift").desc(), F.concat_ws(",", "antecedents").asc()]


def top_rules(rules: DataFrame, k: int, by: Sequence[str] = ()) -> DataFrame:
    """The best ``k`` rules, overall or per group."""
    if not by:
        return rules.orderBy(*_order(rules)).limit(k)
    place = F.row_number().over(W.partitionBy(*by).orderBy(*_order(rules)))
    return rules.withColumn("_place", place).filter(F.col("_place") <= k).drop("_place")


def rule_stats(rules: DataFrame) -> DataFrame:
    return rules.agg(F.count("*").alias("rules"), F.avg("support").alias("mean_support"),
                     F.avg("confidence").alias("mean_confidence"), F.avg("lift").alias("mean_lift"),
                     F.min("lift").alias("min_lift"), F.max("lift").alias("max_lift"))


def weakest_rules(rules: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` least confident rules with a warning band."""
    c = F.col("confidence")
    note = F.when(c < 0.65, "check").when(c < 0.7, "careful").otherwise("fair")
    return rules.orderBy(c, F.concat_ws(",", "antecedents")).limit(k).withColumn("note", note)


def rule_item_freq(rules: DataFrame) -> DataFrame:
    """How many rules name each item in their antecedent."""
    return rules.select(F.explode("antecedents").alias("item")).groupBy("item").agg(F.count("*").alias("rules"))


def rule_edges(rules: DataFrame) -> DataFrame:
    """Item -> consequent edges with mean lift, mean confidence and rule count."""
    return (rules.select(F.explode("antecedents").alias("item"), F.concat_ws(",", "consequents").alias("consequent"),
                         "lift", "confidence")
            .groupBy("item", "consequent").agg(F.avg("lift").alias("mean_lift"), F.avg("confidence").alias("mean_confidence"),
                                               F.count("*").alias("rules")))
