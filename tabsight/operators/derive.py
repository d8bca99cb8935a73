"""Derived columns. All of them are narrow projections; only the unit sniffing needs one average."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsight.functions.expressions import band, bin_right_closed, recode

# Published cut points for age, body mass, pressure stages and lifestyle risk.
AGE_EDGES = [0, 29, 39, 49, 59, 200]
RATIO_EDGES = [0, 18.5, 25, 30, 1000]
HIGH_CUTS = (120, 130, 140, 180)
LOW_CUTS = (80, 90, 120)
LEVEL_CODES = {1: 0, 2: 1, 3: 2}
RISK_BANDS = [(-0.25, False, "Very Good"), (0.0, False, "Good"), (0.5, True, "Medium")]
RISK_LAST = "Bad"
NORMAL_RANGE = (18.5, 25.0)


def unit_convert(df: DataFrame, column: str, out: str, *, mean_above: float = 120.0, unit: float = 365.0) -> DataFrame:
    """Whole units: divide by ``unit`` if the column's mean shows that it holds the small unit."""
    mean = df.agg(F.avg(column).alias("m")).first()["m"]
    x = F.col(column) / F.lit(unit) if mean is not None and mean > mean_above else F.col(column)
    return df.withColumn(out, x.cast("int")).drop(column)


def bucket_fixed(df: DataFrame, column: str, out: str, edges: Sequence[float] = tuple(AGE_EDGES)) -> DataFrame:
    """Right-closed bucket number, the lowest edge included."""
    return df.withColumn(out, bin_right_closed(column, list(edges), include_lowest=True))


def guarded_ratio(df: DataFrame, num: str, den: str, out: str, scale: float = 100.0) -> DataFrame:
    """``num / ((den/scale)^2 + 1e-9)`` where both are positive, else NULL."""
    d = F.col(den) / F.lit(scale)
    return df.withColumn(out, F.when((F.col(num) > 0) & (F.col(den) > 0), F.col(num) / (d * d + F.lit(1e-9))))


def guarded_diff(df: DataFrame, high: str, low: str, out: str) -> DataFrame:
    """``high - low`` where both are positive and in order, else NULL."""
    h, l = F.col(high), F.col(low)
    return df.withColumn(out, F.when((h > 0) & (l > 0) & (h > l), h - l))


def stage(high: str, low: str, high_cuts: Sequence[float] = HIGH_CUTS, low_cuts: Sequence[float] = LOW_CUTS) -> Column:
    """Stage 0-4 of a pair of readings: the highest stage whose rule holds, 0 if none does."""
    h, l = F.col(high), F.col(low)
    a, b, c, d = high_cuts
    x, y, z = low_cuts
    return (F.when((h >= d) | (l >= z), 4)
            .when(((h >= c) & (h < d)) | ((l >= y) & (l < z)), 3)
            .when(((h >= b) & (h < c)) | ((l >= x) & (l < y)), 2)
            .when((h >= a) & (h < b) & (l < x), 1)
            .otherwise(0))


def stage_rules(df: DataFrame, high: str, low: str, out: str, **cuts: Sequence[float]) -> DataFrame:
    return df.withColumn(out, stage(high, low, **cuts))


def threshold_flags(df: DataFrame, above: Mapping[str, float] | None = None,
                    at_least: Mapping[str, float] | None = None) -> DataFrame:
    """0/1 columns ``c_high`` (c > t) and ``c_flag`` (c >= t); NULL gives 0."""
    hi = {f"{c}_high": F.coalesce((F.col(c) > t).cast("int"), F.lit(0)) for c, t in (above or {}).items()}
    ge = {f"{c}_flag": F.coalesce((F.col(c) >= t).cast("int"), F.lit(0)) for c, t in (at_least or {}).items()}
    return df.withColumns({**hi, **ge})


def level_recode(df: DataFrame, column: str, out: str, codes: Mapping[int, int] | None = None,
                 default: int = 0) -> DataFrame:
    return df.withColumn(out, recode(column, codes or LEVEL_CODES, default))


def composite_score(df: DataFrame, weights: Mapping[str, float], out: str) -> DataFrame:
    """Weighted sum of the columns that exist, NULL counting 0."""
    total = F.lit(0.0)
    for c, w in weights.items():
        if c in df.columns:
            total = total + F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * F.lit(float(w))
    return df.withColumn(out, total)


def interactions(df: DataFrame, pairs: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Products of column pairs, skipping pairs with a missing column."""
    return df.withColumns({out: F.col(a) * F.col(b) for out, (a, b) in pairs.items()
                           if a in df.columns and b in df.columns})


def display_name(name: Column | str) -> Column:
    """Text after the first double underscore."""
    c = F.col(name) if isinstance(name, str) else name
    return F.regexp_replace(c, "^.*?__", "")


def score_band(df: DataFrame, column: str, out: str, bands: Sequence[tuple[float, bool, str]] = tuple(RISK_BANDS),
               last: str = RISK_LAST) -> DataFrame:
    return df.withColumn(out, band(column, bands, last))


def two_state(column: str, normal: tuple[float, float] = NORMAL_RANGE) -> Column:
    """'Normal' inside ``[low, high)``, else 'Abnormal'."""
    x = F.col(column)
    return F.when((x >= normal[0]) & (x < normal[1]), "Normal").otherwise("Abnormal")
