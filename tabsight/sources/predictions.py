"""Prediction tables: one naming, one source per id, and a manifest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Accepted column names, most specific first.
TRUE_NAMES = ["y_true", "y", "target", "label", "outcome"]
PRED_NAMES = ["y_pred", "oof", "pred", "prediction", "prob"]


def _first(columns: Sequence[str], names: Sequence[str], what: str) -> str:
    for n in names:
        if n in columns:
            return n
    raise ValueError(f"no {what} column among {list(columns)}")


def normalise_predictions(df: DataFrame, *, key: str | None = None, model: str = "model") -> DataFrame:
    """``id, fold, model, y_true, y_pred`` with defaults, filled gaps and probabilities in [0, 1].

    ``key`` names the id column when it is not called ``id``: rows have no position to fall back on.
    """
    y, p = _first(df.columns, TRUE_NAMES, "outcome"), _first(df.columns, PRED_NAMES, "prediction")
    pred = F.coalesce(F.nanvl(F.col(p).cast("double"), F.lit(None).cast("double")), F.lit(0.5))
    return df.select(
        F.col(key or "id").cast("bigint").alias("id"),
        (F.col("fold") if "fold" in df.columns else F.lit(-1)).cast("int").alias("fold"),
        (F.col("model") if "model" in df.columns else F.lit(model)).alias("model"),
        F.coalesce(F.col(y), F.lit(0)).cast("int").alias("y_true"),
        F.greatest(F.least(pred, F.lit(1.0)), F.lit(0.0)).alias("y_pred"))


def prefer_source(df: DataFrame, priority: Sequence[str], *, by: Sequence[str] = ("model", "id"),
                  source: str = "source") -> DataFrame:
    """One row per key, from the best source that has it. A map-side combined aggregate, not a sort."""
    order = F.coalesce(F.array_position(F.array(*[F.lit(s) for s in priority]), F.col(source)), F.lit(0))
    ranked = df.withColumn("_rank", F.when(order == 0, len(priority) + 1).otherwise(order))
    rest = [c for c in df.columns if c not in by]
    best = ranked.groupBy(*by).agg(F.min(F.struct("_rank", source, *[c for c in rest if c != source])).alias("b"))
    return best.select(*[F.col(c) if c in by else F.col(f"b.{c}").alias(c) for c in df.columns])


def prediction_manifest(df: DataFrame, *, by: Sequence[str] = ("model",), id: str = "id", y: str = "y_true",
                        fold: str = "fold") -> DataFrame:
    """Rows, columns, positive ratio, distinct ids and folds present."""
    per_id = df.groupBy(*by, id).agg(F.count("*").alias("m"), F.sum(F.col(y).cast("bigint")).alias("pos"),
                                     F.collect_set(fold).alias("f"))
    out = per_id.groupBy(*by).agg(
        F.sum("m").alias("rows"), F.count("*").alias("ids"), (F.sum("pos") / F.sum("m")).alias("positive_ratio"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("f")))).alias("f"))
    return out.select(*by, "rows", F.lit(len(df.columns)).alias("columns"), "positive_ratio", "ids",
                      F.concat_ws(",", F.transform("f", lambda v: v.cast("string"))).alias("folds"))
