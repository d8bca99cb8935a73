"""Repair, capping and imputation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsight.functions.expressions import clamp, finite
from tabsight.operators.profiling import filter_sanity, iqr_masks, most_frequent, percentile_limits
from tabsight.operators.quantiles import median, quantile_values
from tabsight.operators.small import fetch_bounded, moments
from tabsight.sources.files import materialised

DEFAULT_GAP = 40.0


def pair_repair(df: DataFrame, high: str, low: str, *, high_range: tuple[float, float] = (90, 240),
                low_range: tuple[float, float] = (60, 140), drop_negative: bool = True, swap: bool = True,
                cap: bool = True, default_gap: float = DEFAULT_GAP) -> DataFrame:
    """Make ``high`` exceed ``low``: drop negatives, swap, clamp, then lift by the median difference."""
    out = df.filter((F.col(high) >= 0) & (F.col(low) >= 0)) if drop_negative else df
    h, l = F.col(high), F.col(low)
    if swap:
        # a missing reading is not filled with the other one
        out = out.withColumns({high: F.when(l > h, l).otherwise(h), low: F.when(l > h, h).otherwise(l)})
    if cap:
        out = out.withColumns({high: clamp(high, *high_range), low: clamp(low, *low_range)})
    sound = out.filter((h > l) & (h >= high_range[0]) & (l >= low_range[0]))
    gap = median(sound.select((h - l).cast("double").alias("gap")), "gap")
    gap = gap if gap and gap > 0 else default_gap

    out = out.withColumns({high: F.when(h == l, l + F.lit(gap)).otherwise(h).cast("double"),
                           low: l.cast("double")})
    off = (h <= 0) | (l <= 0)
    out = out.withColumns({high: F.when(off, F.greatest(h, F.lit(float(high_range[0])))).otherwise(h),
                           low: F.when(off, F.greatest(l, F.lit(float(low_range[0])))).otherwise(l)})
    return out.withColumn(high, F.when(h <= l, l + F.lit(gap)).otherwise(h))


Caps = Mapping[str, tuple[float | None, float | None]]


def winsorize_fixed(df: DataFrame, caps: Caps, positive_only: Sequence[str] = ()) -> DataFrame:
    """Cap by fixed bounds; for ``positive_only`` columns the lower cap spares values <= 0."""
    out = {}
    for c, (low, high) in caps.items():
        x = F.col(c).cast("double")
        capped = clamp(x, low, high)
        out[c] = F.when(x <= 0, x).otherwise(capped) if c in positive_only else capped
    return df.withColumns(out)


def winsorize_masked(df: DataFrame, caps: Caps, masks: Mapping[str, Column]) -> DataFrame:
    """The same caps, only where a column's outlier mask holds."""
    return df.withColumns({c: F.when(masks[c], clamp(F.col(c).cast("double"), low, high))
                           .otherwise(F.col(c).cast("double")) for c, (low, high) in caps.items()})


def winsorize_masked_iqr(df: DataFrame, caps: Caps, k: float = 1.5) -> DataFrame:
    return winsorize_masked(df, caps, iqr_masks(df, list(caps), k))


def winsorize_pct(df: DataFrame, columns: Sequence[str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Cap at exact percentiles of each column."""
    limits = percentile_limits(df, columns, low, high)
    return df.withColumns({c: clamp(F.col(c).cast("double"), *limits[c]) for c in columns})


def incomplete_columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """The columns that hold a NULL, NaN or infinity, from one cheap scan."""
    has = df.agg(*[F.bool_or(finite(c).isNull()).alias(f"c{i}") for i, c in enumerate(columns)]).first()
    return [c for i, c in enumerate(columns) if has[f"c{i}"]]


def impute_median(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fill missing numbers with the column's median, 0 if it has none. Complete columns cost nothing more."""
    todo = incomplete_columns(df, columns)
    mid = quantile_values(df, todo, [0.5]) if todo else {}
    return df.withColumns({c: F.coalesce(finite(c), F.lit(float(mid[c][0] or 0.0))) if c in mid
                           else F.col(c).cast("double") for c in columns})


def impute_mode(df: DataFrame, columns: Sequence[str], default: str = "unknown") -> DataFrame:
    """Fill missing categories with the commonest value, the smallest on ties."""
    top = most_frequent(df, columns)
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(default if top[c] is None else top[c])) for c in columns})


def impute_iterative(df: DataFrame, columns: Sequence[str], max_iter: int = 10, tolerance: float = 1e-3) -> DataFrame:
    """Chained regressions: each incomplete column is predicted from the others, round after round.

    Starts from column means and stops early when no imputed mean moves by more than ``tolerance``
    times the column's range. Each fit is one distributed pass; only coefficients come back.
    """
    start = moments(df, columns)
    todo = [c for c in incomplete_columns(df, columns) if start[c]["n"]]
    if not todo:
        return df
    gaps = {c: f"_gap_{c}" for c in todo}
    base = df.withColumns({gaps[c]: finite(c).isNull() for c in todo})
    filled = base.withColumns({c: F.coalesce(finite(c), F.lit(start[c]["mean"])) for c in columns if start[c]["n"]})
    used = [c for c in columns if start[c]["n"]]
    last: dict[str, float] = {}
    for _ in range(max_iter if len(used) > 1 else 0):
        for c in todo:
            others = [o for o in used if o != c]
            rows = VectorAssembler(inputCols=others, outputCol="_x").transform(
                filled.filter(~F.col(gaps[c])).select(*others, F.col(c).alias("_y")))
            fit = LinearRegression(featuresCol="_x", labelCol="_y", solver="normal", regParam=1e-9).fit(rows)
            guess = F.lit(float(fit.intercept))
            for o, w in zip(others, fit.coefficients):
                guess = guess + F.col(o) * float(w)
            filled = filled.withColumn(c, F.when(F.col(gaps[c]), guess).otherwise(F.col(c)))
        now = filled.agg(*[F.avg(F.when(F.col(gaps[c]), F.col(c))).alias(c) for c in todo]).first().asDict()
        moved = [abs(now[c] - last[c]) / ((start[c]["max"] - start[c]["min"]) or 1.0) for c in todo if c in last]
        last = now
        if moved and max(moved) < tolerance:
            break
    return filled.drop(*gaps.values())


def standardize_onehot(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str],
                       max_levels: int = 1000) -> DataFrame:
    """Median-fill and standardise numbers (population std); mode-fill and one-hot encode categories."""
    out = impute_mode(impute_median(df, numeric), categorical)
    stats = moments(out, numeric)
    scaled = {c: (F.col(c) - stats[c]["mean"]) / (stats[c]["std"] or 1.0) for c in numeric}
    dummies = {}
    for c in categorical:
        levels = sorted(r[0] for r in fetch_bounded(out.select(c).distinct(), max_levels, f"levels of {c}"))
        dummies.update({f"{c}__{v}": (F.col(c) == v).cast("int") for v in levels})
    return out.withColumns({**scaled, **dummies}).drop(*categorical)


def clean_table(df: DataFrame, *, high: str, low: str, high_range: tuple[float, float], low_range: tuple[float, float],
                caps: Caps, numeric: Sequence[str], categorical: Sequence[str], strict: bool = False,
                sanity: Mapping[str, tuple[float, float]] | None = None) -> DataFrame:
    """All cleaning steps in order: deduplicate, filter, repair, cap, impute.

    Every later step fits its statistics on the deduplicated rows, so these are written once instead
    of being shuffled again for each fit.
    """
    out = materialised(df.dropDuplicates())
    if strict:
        out = filter_sanity(out, high, low, strict=True, **(sanity or {}))
    out = pair_repair(out, high, low, high_range=high_range, low_range=low_range)
    out = winsorize_fixed(out, caps)
    return impute_mode(impute_median(out, numeric), categorical)


def clean_metadata(before: DataFrame, after: DataFrame, target: str) -> DataFrame:
    """One row describing a cleaning run."""
    nulls = sum((F.sum(F.col(c).isNull().cast("bigint")) for c in after.columns[1:]),
                F.sum(F.col(after.columns[0]).isNull().cast("bigint")))
    rows = before.count()
    return after.agg(F.count("*").alias("final_count"), nulls.alias("missing_after"),
                     F.avg(F.col(target).cast("double")).alias("positive_ratio")).select(
        F.lit(rows).cast("bigint").alias("initial_count"), "final_count",
        (F.lit(rows) - F.col("final_count")).cast("bigint").alias("removed"),
        F.lit(len(after.columns)).alias("columns"), "missing_after", "positive_ratio")
