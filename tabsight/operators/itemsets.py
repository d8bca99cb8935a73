"""From scores to items, and from items to frequent itemsets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabsight.operators.quantiles import exact_quantiles
from tabsight.operators.small import joined, small_side
from tabsight.sources.files import materialised


def score_normalise(scores: DataFrame, how: str = "max", *, feature: str = "feature", score: str = "score",
                    out: str = "norm") -> DataFrame:
    """Per-feature scaling: 'none', 'max' (divide by the maximum) or 'zscore' (population deviation)."""
    if how == "none":
        return scores.withColumn(out, F.col(score))
    stats = small_side(scores.groupBy(feature).agg(
        F.max(score).alias("_top"), F.avg(score).alias("_mean"), F.stddev_pop(score).alias("_sd")))

    def or_one(c: str):
        return F.when(F.col(c) == 0, 1.0).otherwise(F.col(c))

    value = F.col(score) / or_one("_top") if how == "max" else (F.col(score) - F.col("_mean")) / or_one("_sd")
    return joined(scores, stats, [feature]).withColumn(out, value).drop("_top", "_mean", "_sd")


def binarize_scores(scores: DataFrame, tau: float | str = "p80", *, feature: str = "feature", norm: str = "norm",
                    out: str = "active") -> DataFrame:
    """1 where the score reaches ``tau``: a number, or 'pNN' for each feature's NN-th percentile."""
    if isinstance(tau, str) and tau.lower().startswith("p"):
        cut = exact_quantiles(scores.select(feature, norm), [norm], [float(tau[1:]) / 100.0], by=[feature])
        limits = small_side(cut.select(feature, F.col("q")[0].alias("_cut")))
        return joined(scores, limits, [feature]).withColumn(out, (F.col(norm) >= F.col("_cut")).cast("int")).drop("_cut")
    return scores.withColumn(out, (F.col(norm) >= float(tau)).cast("int"))


def min_active_items(active: DataFrame, at_least: int, *, id: str = "id", feature: str = "feature",
                     score: str = "score", flag: str = "active") -> DataFrame:
    """Rows with fewer than ``at_least`` active items also get their top items by raw score.

    Groups are one row's features, so the window is as wide as the feature list.
    """
    mine = W.partitionBy(id)
    place = F.row_number().over(mine.orderBy(F.col(score).desc(), feature))
    short = F.sum(flag).over(mine) < at_least
    return (active.withColumns({"_place": place, "_short": short})
            .withColumn(flag, F.when(F.col("_short") & (F.col("_place") <= at_least), 1).otherwise(F.col(flag)))
            .drop("_place", "_short"))


def itemset_table(active: DataFrame, labels: DataFrame, *, id: str = "id", feature: str = "feature",
                  flag: str = "active", target: str = "target", target_item: str = "target") -> DataFrame:
    """One row per id: label columns and the sorted ``items``, the target item included if positive."""
    items = active.groupBy(id).agg(F.array_sort(F.collect_list(F.when(F.col(flag) == 1, F.col(feature)))).alias("_items"))
    extra = F.when(F.col(target) == 1, F.array(F.lit(target_item))).otherwise(F.array().cast("array<string>"))
    return (labels.join(items, id)
            .withColumn("items", F.array_sort(F.concat("_items", extra))).drop("_items"))


def compress_baskets(baskets: DataFrame, by: Sequence[str] = (), items: str = "items", weight: str | None = None) -> DataFrame:
    """``by..., items, w``: equal baskets counted once (map-side combined), empty ones included."""
    w = F.sum(weight) if weight else F.count("*")
    return baskets.groupBy(*by, F.array_sort(F.array_distinct(items)).alias("items")).agg(w.alias("w"))


def frequent_itemsets(baskets: DataFrame, *, by: Sequence[str] = (), min_support: float = 0.03, max_len: int = 4,
                      items: str = "items") -> DataFrame:
    """``by..., items, count, rows, support`` of every itemset reaching ``min_support``, per group.

    Vertical layout: equal baskets are merged and numbered, and 64 of them make a word. An item has a bit mask per
    word, an itemset the AND of its items' masks; its support is the number of bits, weighted by the baskets' counts,
    of which each binary digit is a mask as well. So a candidate carries one mask per word and never a basket, a word
    meets its own items only, and a popular basket or itemset gathers no rows in one task.
    """
    keys = list(by) or ["_g"]
    src = baskets if by else baskets.withColumn("_g", F.lit(0))
    base = materialised(compress_baskets(src, keys, items).withColumn("_id", F.monotonically_increasing_id()))
    totals = small_side(base.groupBy(*keys).agg(F.sum("w").alias("rows")))
    digits = int(base.agg(F.max("w")).first()[0] or 0).bit_length()
    word, bit = F.shiftright("_id", 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("_id") % 64).cast("int"))
    planes = base.groupBy(*keys, word).agg(F.array(*[
        F.coalesce(F.bit_or(F.when(F.shiftright("w", j) % 2 == 1, bit)), F.lit(0).cast("long")) for j in range(digits)]).alias("planes"))

    def frequent(state: DataFrame) -> DataFrame:
        weight = F.lit(0).cast("long")
        for j in range(digits):
            weight = weight + F.bit_count(F.col("bits").bitwiseAND(F.col("planes")[j])).cast("long") * (1 << j)
        found = state.groupBy(*keys, F.col("prefix").alias("items")).agg(F.sum(weight).alias("count"))
        return materialised(joined(found, totals, keys).withColumn("support", F.col("count") / F.col("rows"))
                            .filter(F.col("support") >= min_support).select(*keys, "items", "count", "rows", "support"))

    def kept(state: DataFrame, level: DataFrame) -> DataFrame:
        return joined(state, small_side(level.select(*keys, F.col("items").alias("prefix"))), [*keys, "prefix"], "left_semi")

    masks = base.select(*keys, word, bit.alias("bit"), F.explode("items").alias("item")).groupBy(*keys, "word", "item").agg(F.bit_or("bit").alias("bits"))
    state = joined(masks, planes, [*keys, "word"]).withColumn("prefix", F.array("item"))
    levels = [frequent(state)]
    state = materialised(kept(state, levels[0]))
    singles = state.select(*keys, "word", F.col("item").alias("next"), F.col("bits").alias("more"))
    for _ in range(2, max_len + 1):
        both = F.col("bits").bitwiseAND(F.col("more"))
        state = (joined(state, singles, [*keys, "word"]).filter((F.col("next") > F.element_at("prefix", -1)) & (both != 0))
                 .select(*keys, "word", "planes", both.alias("bits"), F.concat("prefix", F.array("next")).alias("prefix")))
        level = frequent(state)
        if not level.take(1):
            break
        levels.append(level)
        state = materialised(kept(state, level))
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out if by else out.drop("_g")


def itemset_quality(baskets: DataFrame, *, target: str, items: str = "items") -> DataFrame:
    """Rows, class counts, missing values and basket sizes over the whole table."""
    size = F.size(items)
    return baskets.agg(
        F.count("*").alias("rows"), F.count_if(F.col(target) == 1).alias("positive"),
        F.count_if(F.col(target) == 0).alias("negative"),
        F.count_if(F.col(target).isNull() | F.col(items).isNull()).alias("missing"),
        F.min(size).alias("min_items"), F.max(size).alias("max_items"), F.avg(size.cast("double")).alias("mean_items"))
