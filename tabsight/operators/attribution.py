"""Per-row feature attributions: step reduction, summaries, comparisons and enrichment.

Attributions come long (id, feature, step, score) or as one matrix column per row
(features x steps). The matrix form never needs a shuffle to reduce the steps.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsight.operators.derive import RISK_BANDS, RISK_LAST, score_band
from tabsight.operators.small import fetch_bounded

_REDUCE = {"mean": F.avg, "max": F.max, "sum": F.sum}


def step_aggregate(df: DataFrame, how: str = "mean", *, keys: Sequence[str] = ("id", "feature"),
                   score: str = "score") -> DataFrame:
    """One score per row and feature from a long table: mean, max or sum over the steps."""
    return df.groupBy(*keys).agg(_REDUCE[how](score).alias(score))


def step_aggregate_matrix(df: DataFrame, matrix: str, features: Sequence[str], how: str = "mean",
                          keys: Sequence[str] = ("id",)) -> DataFrame:
    """The same from a matrix column, in a narrow projection: ``keys..., feature, score``."""
    def reduce(steps: Column) -> Column:
        if how == "max":
            return F.array_max(steps)
        total = F.aggregate(steps, F.lit(0.0), lambda acc, v: acc + v)
        return total if how == "sum" else total / F.size(steps)

    names = F.array(*[F.lit(f) for f in features])
    return df.select(*keys, F.inline(F.transform(
        F.arrays_zip(names.alias("f"), F.col(matrix).alias("m")),
        lambda z: F.struct(z["f"].alias("feature"), reduce(z["m"]).alias("score")))))


def attribution_global(scores: DataFrame, *, fold: str = "fold", feature: str = "feature",
                       score: str = "score") -> DataFrame:
    """Mean per fold and feature, and overall mean, population deviation and count.

    One scan: the overall figures are combined from the per-fold moments.
    """
    per = scores.groupBy(fold, feature).agg(
        F.avg(score).alias("m"), F.var_pop(score).alias("v"), F.count("*").alias("n"))
    mean = per.groupBy(feature).agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("all_m"))
    spread = F.col("n") * (F.col("v") + (F.col("m") - F.col("all_m")) * (F.col("m") - F.col("all_m")))
    overall = per.join(mean, feature).groupBy(feature, "all_m").agg(
        F.sqrt(F.sum(spread) / F.sum("n")).alias("sd"), F.sum("n").alias("n"))
    return (per.select(F.concat(F.lit("fold_"), F.col(fold).cast("string")).alias("fold"), feature,
                       F.col("m").alias("mean_score"), F.lit(None).cast("double").alias("std_score"),
                       F.col("n").alias("n_samples"))
            .unionByName(overall.select(F.lit("global").alias("fold"), feature, F.col("all_m").alias("mean_score"),
                                        F.col("sd").alias("std_score"), F.col("n").alias("n_samples"))))


def attribution_by_cohort(scores: DataFrame, cohorts: DataFrame, *, id: str = "id", feature: str = "feature",
                          score: str = "score") -> DataFrame:
    """Mean score per (cohort column = value, feature) over ids that have cohort labels."""
    columns = [c for c in cohorts.columns if c != id]
    joined = scores.select(id, feature, score).join(cohorts, id)
    long = joined.select(feature, score, F.inline(F.array(
        *[F.struct(F.lit(c).alias("scope"), F.concat(F.lit(f"{c}="), F.col(c).cast("string")).alias("group"))
          for c in columns])))
    return long.groupBy("scope", "group", feature).agg(F.avg(score).alias("mean_score"),
                                                       F.count("*").alias("n_samples"))


def top_features(summary: DataFrame, k: int = 10, *, value: str = "mean_score", feature: str = "feature") -> DataFrame:
    """The ``k`` features with the largest value, and how many of all features exceed the mean."""
    mean = summary.agg(F.avg(value).alias("m")).first()["m"]
    above = summary.agg(F.count_if(F.col(value) > mean).alias("n")).first()["n"]
    return (summary.orderBy(F.col(value).desc(), feature).limit(k)
            .select(feature, value, F.lit(above).cast("bigint").alias("above_mean")))


def importance_compare(a: DataFrame, b: DataFrame, *, feature: str = "feature", value: str = "mean_score",
                       names: tuple[str, str] = ("a", "b")) -> DataFrame:
    """Two models' importances side by side; a feature of only one model keeps its row."""
    return (a.select(feature, F.col(value).alias(f"{names[0]}_mean"))
            .join(b.select(feature, F.col(value).alias(f"{names[1]}_mean")), feature, "full"))


def importance_pivot(df: DataFrame, folds: Sequence[int], top: int, *, feature: str = "feature", fold: str = "fold",
                     value: str = "score") -> DataFrame:
    """Feature x fold means, 0 where absent, the largest in the first fold first."""
    wide = df.groupBy(feature).pivot(fold, list(folds)).agg(F.avg(value))
    named = wide.select(feature, *[F.coalesce(F.col(str(f)), F.lit(0.0)).alias(f"fold_{f}") for f in folds])
    return named.orderBy(F.col(f"fold_{folds[0]}").desc(), feature).limit(top)


def family_contribution(a: DataFrame, b: DataFrame, family: Sequence[str], *, feature: str = "feature",
                        value: str = "mean_score") -> DataFrame:
    """Share of a feature family in both models' totals, and the b/a ratio per member (0 if missing)."""
    both = importance_compare(a, b, feature=feature, value=value)
    member = F.col(feature).isin(list(family))

    def share(c: str) -> Column:
        return 100 * F.sum(F.when(member, F.col(c)).otherwise(0.0)) / F.sum(c)

    totals = fetch_bounded(both.agg(share("a_mean").alias("a"), share("b_mean").alias("b")), 1)[0]
    listed = both.sparkSession.createDataFrame([(f,) for f in family], f"{feature} string")
    ratio = F.when((F.col("a_mean") > 0) & F.col("b_mean").isNotNull(), F.col("b_mean") / F.col("a_mean"))
    return listed.join(both, feature, "left").select(
        feature, F.coalesce(ratio, F.lit(0.0)).alias("ratio"),
        F.lit(totals["a"]).cast("double").alias("a_pct"), F.lit(totals["b"]).cast("double").alias("b_pct"))


def importance_summary(df: DataFrame, *, fold: str = "fold", feature: str = "feature", value: str = "importance",
                       model: str = "rf") -> DataFrame:
    """Global mean and sample deviation over folds plus the fold rows, in one long table."""
    overall = df.groupBy(feature).agg(F.avg(value).alias("mean_importance"), F.stddev_samp(value).alias("std_importance"),
                                      F.count_distinct(fold).alias("n_samples"))
    none = F.lit(None)
    rows = df.select(feature, F.lit("fold").alias("scope"), F.concat(F.lit("fold_"), F.col(fold).cast("string")).alias("group"),
                     F.col(value).alias("mean_importance"), none.cast("double").alias("std_importance"),
                     none.cast("bigint").alias("n_samples"))
    return (overall.withColumns({"scope": F.lit("global"), "group": F.lit("all")}).unionByName(rows)
            .withColumn("model", F.lit(model)))


def enrich_predictions(pred: DataFrame, tables: Sequence[DataFrame], key: str) -> DataFrame:
    """Predictions with feature columns looked up by key in the union of the tables; misses stay NULL."""
    features = tables[0]
    for t in tables[1:]:
        features = features.unionByName(t)
    return pred.join(features.withColumn("_hit", F.lit(True)), key, "left").withColumn(
        "matched", F.coalesce("_hit", F.lit(False))).drop("_hit")


def enrich_stats(enriched: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Matched rows and missing values per column."""
    return enriched.agg(F.count("*").alias("rows"), F.count_if("matched").alias("matched"),
                        *[F.count_if(F.col(c).isNull()).alias(f"missing_{c}") for c in columns])


def detail_table(df: DataFrame, required: Sequence[str], risk: str, *, p: str, columns: Sequence[str],
                 bands: Sequence = tuple(RISK_BANDS), last: str = RISK_LAST) -> DataFrame:
    """Complete rows with the risk band, the most probable first."""
    full = score_band(df.dropna(subset=list(required)), risk, "band", bands, last)
    return full.select(*columns, "band").orderBy(F.col(p).desc(), columns[0])


def distribution_stats(df: DataFrame, risk: str, flags: Sequence[str] = ()) -> DataFrame:
    """Range, mean, sample deviation and counts below 0, within 0..0.5 and above; flag counts."""
    r = F.col(risk)
    return df.agg(F.min(r).alias("min"), F.max(r).alias("max"), F.avg(r).alias("mean"), F.stddev_samp(r).alias("std"),
                  F.count_if(r < 0).alias("good"), F.count_if((r >= 0) & (r <= 0.5)).alias("medium"),
                  F.count_if(r > 0.5).alias("bad"),
                  *[F.count_if(F.col(f) == v).alias(f"{f}_{v}") for f in flags for v in (0, 1)])


def band_stats(df: DataFrame, band: str, *, y: str, p: str, threshold: float = 0.5) -> DataFrame:
    """Per band: mean and deviation of the probability, count, positive rate and accuracy."""
    correct = ((F.col(p) >= threshold).cast("int") == F.col(y)).cast("double")
    return df.groupBy(band).agg(F.avg(p).alias("mean_prob"), F.stddev_samp(p).alias("std_prob"), F.count("*").alias("n"),
                                F.avg(F.col(y).cast("double")).alias("positive_rate"), F.avg(correct).alias("accuracy"))
