"""Small results: fetch them with a proven bound, or leave them distributed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from tabsight.functions.expressions import finite

SMALL_ROWS = 10_000


def fetch_bounded(df: DataFrame, limit: int = SMALL_ROWS, what: str = "result") -> list[Row]:
    """Collect at most ``limit`` rows; more is an error, never a silent cut."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{what} has more than {limit} rows")
    return rows


def small_side(df: DataFrame, limit: int = SMALL_ROWS) -> DataFrame:
    """A join side that is broadcast if it has at most ``limit`` rows, else left to a shuffled join."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


def joined(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on keys of which NULL equals NULL, so that no group is lost; the keys come from the left side."""
    keys = list(keys)
    other = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    match = [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys]
    if not match:
        return left.join(other, F.lit(True), how)
    condition = match[0]
    for m in match[1:]:
        condition = condition & m
    out = left.join(other, condition, how)
    return out if how in ("left_semi", "left_anti") else out.drop(*[f"_right_{k}" for k in keys])


def moments(df: DataFrame, columns: Sequence[str]) -> dict[str, dict[str, float]]:
    """Count, mean and population deviation of several columns' finite values, in one scan."""
    x = {c: finite(c) for c in columns}
    row = df.agg(*[f for i, c in enumerate(columns) for f in (
        F.count(x[c]).alias(f"n{i}"), F.avg(x[c]).alias(f"m{i}"), F.stddev_pop(x[c]).alias(f"s{i}"),
        F.min(x[c]).alias(f"a{i}"), F.max(x[c]).alias(f"b{i}"))]).first()
    return {c: {"n": row[f"n{i}"], "mean": row[f"m{i}"], "std": row[f"s{i}"], "min": row[f"a{i}"],
                "max": row[f"b{i}"]} for i, c in enumerate(columns)}
