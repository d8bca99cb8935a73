"""Aggregates of groups brought back to their rows, whatever share of the rows one group holds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsight.sources.files import materialised

#: A group is hot with more than this share of all rows; fewer groups than its inverse can be.
HOT_SHARE = 1000


def with_groups(rows: DataFrame, keys: Sequence[str], aggregates: Sequence[Column], id_name: str | None = None) -> DataFrame:
    """The rows with ``n`` (rows of their group), the group's aggregates and, where wanted, an integer that names it.

    ``rows`` is a written table, as it is read twice. Groups are made with map-side combine and written. Those with
    more than a thousandth of all rows are fewer than a thousand, whatever the input, and are broadcast; a key of
    the shuffled join for the rest has a thousandth of the rows at most. Nulls are equal to nulls.
    """
    groups = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *aggregates)
    if id_name:
        groups = groups.sortWithinPartitions(*keys).withColumn(id_name, F.monotonically_increasing_id())
    groups = materialised(groups).withColumnsRenamed({k: f"group_{k}" for k in keys})
    limit = (groups.agg(F.sum("n")).first()[0] or 0) // HOT_SHARE
    match = [F.col(k).eqNullSafe(F.col(f"group_{k}")) for k in keys]
    hot, cold = groups.filter(F.col("n") > limit), groups.filter(F.col("n") <= limit)
    common = rows.join(F.broadcast(hot), match)
    rare = rows.join(F.broadcast(hot), match, "left_anti").join(cold, match)
    return common.unionByName(rare).drop(*[f"group_{k}" for k in keys])
