"""Profiling and data quality. Statistics are fitted first (a few numbers), then applied as literals,
so that applying them is a narrow projection without joins."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsight.functions.expressions import bin_right_closed, finite, melt, ratio
from tabsight.operators.quantiles import exact_quantiles, quantile_values
from tabsight.operators.ranking import running_totals
from tabsight.operators.small import joined, moments, small_side

PROPOSED = 8
TRACKED = 10_000
_SKETCHED = (T.StringType, T.BooleanType, T.IntegralType, T.DateType, T.DecimalType)


def profile_summary(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str] = ()) -> DataFrame:
    """One row per column: count, mean, std, min, quartiles, max; or unique, top, freq."""
    def stats(c: str) -> Column:
        x = F.col(c).cast("double")
        return F.struct(F.lit(c).alias("column"), F.count(x).alias("count"), F.avg(x).alias("mean"),
                        F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"))

    none, blank = F.lit(None).cast("double"), F.lit(None).cast("string")
    num = (df.agg(F.array(*[stats(c) for c in numeric]).alias("a")).select(F.inline("a"))
           .join(exact_quantiles(df, numeric, [0.25, 0.5, 0.75]).select("column", "q"), "column")
           .select("column", "count", "mean", "std", "min", F.col("q")[0].alias("q25"), F.col("q")[1].alias("q50"),
                   F.col("q")[2].alias("q75"), "max", F.lit(None).cast("bigint").alias("unique"),
                   blank.alias("top"), F.lit(None).cast("bigint").alias("freq")))
    if not categorical:
        return num
    cat = (melt(df, [], categorical, cast="string").filter(F.col("value").isNotNull())
           .groupBy("column", "value").agg(F.count("*").alias("m"))
           .groupBy("column").agg(F.sum("m").alias("count"), F.count("*").alias("unique"), F.max("m").alias("freq"),
                                  F.min_by("value", F.struct(-F.col("m"), F.col("value"))).alias("top"))
           .select("column", "count", none.alias("mean"), none.alias("std"), none.alias("min"), none.alias("q25"),
                   none.alias("q50"), none.alias("q75"), none.alias("max"), "unique", "top", "freq"))
    return num.unionByName(cat)


def zscore_masks(df: DataFrame, columns: Sequence[str], z: float = 4.0) -> dict[str, Column]:
    """|x - mean| / population std > z, per column; all False for a constant or near-empty column."""
    out = {}
    for c, m in moments(df, columns).items():
        if m["n"] < 2 or not m["std"]:
            out[c] = F.lit(False)
        else:
            out[c] = F.coalesce(F.abs(finite(c) - m["mean"]) / m["std"] > z, F.lit(False))
    return out


def iqr_masks(df: DataFrame, columns: Sequence[str], k: float = 1.5) -> dict[str, Column]:
    """Outside [Q1 - k IQR, Q3 + k IQR], per column; all False below four values or for a zero range."""
    counts = {r["column"]: r for r in exact_quantiles(df, columns, [0.25, 0.75]).collect()}
    out = {}
    for c in columns:
        r = counts.get(c)
        if r is None or r["n"] < 4 or r["q"][0] == r["q"][1]:
            out[c] = F.lit(False)
            continue
        q1, q3 = r["q"]
        x = finite(c)
        out[c] = F.coalesce((x < q1 - k * (q3 - q1)) | (x > q3 + k * (q3 - q1)), F.lit(False))
    return out


def outlier_zscore(df: DataFrame, columns: Sequence[str], z: float = 4.0) -> DataFrame:
    return df.withColumns({f"{c}_outlier": m for c, m in zscore_masks(df, columns, z).items()})


def outlier_iqr(df: DataFrame, columns: Sequence[str], k: float = 1.5) -> DataFrame:
    return df.withColumns({f"{c}_outlier": m for c, m in iqr_masks(df, columns, k).items()})


def outlier_counts(df: DataFrame, columns: Sequence[str], z: float = 4.0, k: float = 1.5) -> DataFrame:
    """Rows flagged per column by either rule."""
    zs, iq = zscore_masks(df, columns, z), iqr_masks(df, columns, k)
    cells = [F.struct(F.lit(c).alias("column"), F.sum(zs[c].cast("bigint")).alias("zscore_count"),
                      F.sum(iq[c].cast("bigint")).alias("iqr_count")) for c in columns]
    return df.agg(F.array(*cells).alias("a")).select(F.inline("a"))


def quality_flags(df: DataFrame, high: str, low: str, max_high: float = 240, min_low: float = 40) -> DataFrame:
    """Rule flags for a pair of columns where ``high`` should exceed ``low``; a missing reading raises none."""
    h, l = F.col(high), F.col(low)
    flags = {"flag_low_gt_high": l > h, "flag_high_extreme": h > max_high, "flag_low_extreme": l < min_low,
             "flag_high_negative": h < 0, "flag_low_negative": l < 0, "flag_negative": (h < 0) | (l < 0)}
    return df.withColumns({k: F.coalesce(v, F.lit(False)) for k, v in flags.items()})


QUALITY_FLAGS = ["flag_low_gt_high", "flag_high_extreme", "flag_low_extreme", "flag_high_negative",
                 "flag_low_negative", "flag_duplicate"]


def duplicate_flag(df: DataFrame, columns: Sequence[str] | None = None, name: str = "flag_duplicate") -> DataFrame:
    """True for every row whose listed columns (default: all) occur more than once.

    Copies are counted with map-side combine and only repeated keys are joined back, so the join side
    holds one row per repeated key. A key shared by very many rows is split by AQE's skew join; a
    window over the key would put all its copies in one task.
    """
    keys = list(columns or df.columns)
    repeated = (df.groupBy(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)])
                .agg(F.count("*").alias("_copies")).filter(F.col("_copies") > 1))
    same = None
    for i, c in enumerate(keys):
        eq = df[c].eqNullSafe(repeated[f"_k{i}"])
        same = eq if same is None else same & eq
    return (df.join(repeated, same, "left").withColumn(name, F.col("_copies").isNotNull())
            .drop("_copies", *[f"_k{i}" for i in range(len(keys))]))


def quality_counts(flagged: DataFrame, flags: Sequence[str] = tuple(QUALITY_FLAGS)) -> DataFrame:
    """Rows per raised flag."""
    cells = [F.struct(F.lit(f).alias("issue"), F.sum(F.col(f).cast("bigint")).alias("n")) for f in flags]
    return flagged.agg(F.array(*cells).alias("a")).select(F.inline("a"))


def flagged_records(flagged: DataFrame, flags: Sequence[str] = tuple(QUALITY_FLAGS)) -> DataFrame:
    """Rows with at least one raised flag."""
    hit = F.lit(False)
    for f in flags:
        hit = hit | F.col(f)
    return flagged.filter(hit)


def sanity_flags(df: DataFrame, high: str, low: str, high_range: tuple[float, float] = (80, 240),
                 low_range: tuple[float, float] = (40, 180)) -> DataFrame:
    """0/1 flags: swapped, out of range, non-positive difference, and whether any is raised.

    A missing reading raises no flag.
    """
    h, l = F.col(high), F.col(low)
    flags = {"swap_suspect": l > h, "high_unreal": (h < high_range[0]) | (h > high_range[1]),
             "low_unreal": (l < low_range[0]) | (l > low_range[1]), "diff_not_positive": h - l <= 0}
    out = df.withColumns({k: F.coalesce(v.cast("int"), F.lit(0)) for k, v in flags.items()})
    return out.withColumn("any_flag", F.greatest("swap_suspect", "high_unreal", "low_unreal", "diff_not_positive"))


def filter_sanity(df: DataFrame, high: str, low: str, strict: bool = False, **ranges: tuple[float, float]) -> DataFrame:
    """Keep rows without any flag (strict) or without a swap or non-positive difference (lenient)."""
    flagged = sanity_flags(df, high, low, **ranges)
    keep = F.col("any_flag") == 0 if strict else (F.col("swap_suspect") == 0) & (F.col("diff_not_positive") == 0)
    return flagged.filter(keep).select(*df.columns)


def quality_report(df: DataFrame, *, high: str, low: str, max_high: float, min_low: float,
                   ranges: Mapping[str, tuple[float, float]], target: str,
                   max_imbalance: float = 0.1) -> DataFrame:
    """Found issues with count, percentage and severity; issues without any row are left out."""
    h, l = F.col(high), F.col(low)

    def issue(category: str, feature: str, severity: str, n: Column, base: Column) -> Column:
        return F.struct(F.lit(category).alias("category"), F.lit(feature).alias("feature"),
                        n.cast("bigint").alias("n"), (100 * ratio(n, base)).alias("pct"),
                        F.lit(severity).alias("severity"))

    def hits(c: Column) -> Column:
        return F.sum(F.coalesce(c, F.lit(False)).cast("bigint"))

    rows = F.count("*")
    nulls = sum((F.sum(F.col(c).isNull().cast("bigint")) for c in df.columns[1:]),
                F.sum(F.col(df.columns[0]).isNull().cast("bigint")))
    cells = [
        issue("data_fix", f"{low}>{high}", "High", hits(l > h), rows),
        issue("data_fix", high, "Medium", hits(h > max_high), rows),
        issue("data_fix", low, "Medium", hits(l < min_low), rows),
        issue("missing", "*", "Medium", nulls, rows * len(df.columns)),
        *[issue("outlier", c, "Low", hits((F.col(c) > hi) | (F.col(c) < lo)), rows)
          for c, (lo, hi) in ranges.items()]]
    ones, zeros = F.sum((F.col(target) == 1).cast("bigint")), F.sum((F.col(target) == 0).cast("bigint"))
    uneven = F.abs(ones - zeros)
    cells.append(issue("class_imbalance", target, "High",
                       F.when(ratio(uneven, rows) > max_imbalance, uneven).otherwise(F.lit(0)), rows))
    main = df.agg(F.array(*cells).alias("a")).select(F.inline("a"))
    copies = (df.groupBy(*df.columns).agg(F.count("*").alias("m"))
              .agg(issue("duplicate", "*", "Low", F.sum(F.col("m") - 1), F.sum("m")).alias("s")).select("s.*"))
    return main.unionByName(copies).filter(F.col("n") > 0)


def missing_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """NULLs and their percentage per column."""
    cells = [F.struct(F.lit(c).alias("column"), F.sum(F.col(c).isNull().cast("bigint")).alias("n"),
                      (100 * ratio(F.sum(F.col(c).isNull().cast("bigint")), F.count("*"))).alias("pct"))
             for c in (columns or df.columns)]
    return df.agg(F.array(*cells).alias("a")).select(F.inline("a"))


def class_balance(df: DataFrame, target: str, max_gap: float = 0.1,
                  band: tuple[float, float] = (0.45, 0.55)) -> DataFrame:
    """Count and share of both classes, with imbalance flags."""
    one = F.sum((F.col(target) == 1).cast("bigint"))
    zero = F.sum((F.col(target) == 0).cast("bigint"))
    t = df.agg(zero.alias("n0"), one.alias("n1"), F.count(target).alias("n"))
    p0, p1 = ratio(F.col("n0"), F.col("n")), ratio(F.col("n1"), F.col("n"))
    return t.select(F.inline(F.array(*[
        F.struct(F.lit(k).alias("class"), F.col(f"n{k}").alias("n"), p.alias("share"),
                 (F.abs(p0 - p1) > max_gap).alias("imbalanced"),
                 ((p1 < band[0]) | (p1 > band[1])).alias("outside_band"))
        for k, p in ((0, p0), (1, p1))])))


def target_rate_by_category(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """Rows and mean target per level of every listed column, in one pass."""
    return (melt(df, [target], columns, cast="string").groupBy("column", F.col("value").alias("level"))
            .agg(F.count("*").alias("n"), F.avg(F.col(target).cast("double")).alias("rate")))


def group_means(df: DataFrame, by: str, columns: Sequence[str],
                shares: Mapping[str, Column] | None = None) -> DataFrame:
    """Column means, and shares of conditions, per group."""
    return df.groupBy(by).agg(
        F.count("*").alias("n"), *[F.avg(F.col(c).cast("double")).alias(f"mean_{c}") for c in columns],
        *[F.avg(cond.cast("double")).alias(name) for name, cond in (shares or {}).items()])


def binned_target_rate(df: DataFrame, edges: Mapping[str, Sequence[float]], target: str) -> DataFrame:
    """Mean target per right-closed bin of every listed column; values outside the edges are dropped."""
    cells = [F.struct(F.lit(c).alias("column"), bin_right_closed(c, e).alias("bin")) for c, e in edges.items()]
    bounds = {c: (F.array(*[F.lit(float(v)) for v in e])) for c, e in edges.items()}
    lower = F.coalesce(*[F.when(F.col("column") == c, b[F.col("bin")]) for c, b in bounds.items()])
    upper = F.coalesce(*[F.when(F.col("column") == c, b[F.col("bin") + 1]) for c, b in bounds.items()])
    return (df.select(F.col(target).cast("double").alias("_y"), F.inline(F.array(*cells)))
            .filter(F.col("bin").isNotNull())
            .groupBy("column", "bin").agg(F.count("*").alias("n"), F.avg("_y").alias("rate"))
            .withColumns({"lower": lower, "upper": upper}))


def class_histogram(df: DataFrame, column: str, by: str, bins: int = 30) -> DataFrame:
    """Equal-width counts per class, each over its own range; empty bins are left out."""
    src = df.select(by, finite(column).alias("_x")).filter(F.col("_x").isNotNull())
    limits = small_side(src.groupBy(by).agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi")))
    width = F.col("_hi") - F.col("_lo")
    slot = F.when(width == 0, F.lit(bins // 2)).otherwise(
        F.least(F.floor((F.col("_x") - F.col("_lo")) / width * bins), F.lit(bins - 1))).cast("int")
    return joined(src, limits, [by]).groupBy(by, slot.alias("bin")).agg(F.count("*").alias("n"))


def class_quartiles(df: DataFrame, columns: Sequence[str], by: str, k: float = 1.5) -> DataFrame:
    """Box-plot numbers per class: quartiles and the furthest values within ``k`` IQR."""
    q = exact_quantiles(df, columns, [0.25, 0.5, 0.75], by=[by]).select(
        by, "column", "n", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))
    x, reach = F.col("value"), k * (F.col("q3") - F.col("q1"))
    return (joined(melt(df, [by], columns).withColumn("value", finite("value")), small_side(q), [by, "column"])
            .groupBy(by, "column", "n", "q1", "median", "q3").agg(
                F.min(F.when(x >= F.col("q1") - reach, x)).alias("whisker_low"),
                F.max(F.when(x <= F.col("q3") + reach, x)).alias("whisker_high")))


def count_by_value_class(df: DataFrame, value: str | Column, target: str, classes: Sequence[int] = (0, 1),
                         name: str = "value") -> DataFrame:
    """Rows per value and class; a missing combination counts 0."""
    v = F.col(value) if isinstance(value, str) else value
    wide = df.filter(F.col(target).isin(list(classes))).groupBy(v.alias(name)).agg(
        *[F.sum((F.col(target) == k).cast("bigint")).alias(f"n{k}") for k in classes])
    return wide.select(name, F.inline(F.array(*[
        F.struct(F.lit(k).alias("class"), F.col(f"n{k}").alias("n")) for k in classes])))


def ordinal_trend(df: DataFrame, column: str, target: str, levels: Sequence[int] | None = None) -> DataFrame:
    """Least-squares line through the mean target of ordered levels (all, or those listed), in percent."""
    rows = df if levels is None else df.filter(F.col(column).isin(list(levels)))
    rates = (rows.groupBy(F.col(column).cast("double").alias("x"))
             .agg((100 * F.avg(F.col(target).cast("double"))).alias("y")))
    return rates.agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"),
                     F.count("*").alias("levels"))


def poly_trend(df: DataFrame, value: str, target: str, degree: int = 5) -> DataFrame:
    """Polynomial through the positive counts of the ordered distinct values, clipped at 0.

    The power sums are Spark aggregates over the distinct values; only the (degree+1) square system
    is solved on the driver.
    """
    counts = (df.groupBy(value)
              .agg(F.sum((F.col(target) == 1).cast("bigint")).alias("n")).withColumn("one", F.lit(1)))
    placed = running_totals(counts, by=[], value=value, sums={"one": "upto"}).select(
        value, "n", (F.col("upto") - 1).alias("position"))
    last = placed.agg(F.max("position").alias("m")).first()["m"] or 0
    deg = min(degree, last)
    # positions are scaled to [0, 1] to keep the system well conditioned
    x = F.col("position") / F.lit(float(max(last, 1)))
    sums = placed.agg(*[F.sum(F.pow(x, F.lit(i))).alias(f"s{i}") for i in range(2 * deg + 1)],
                      *[F.sum(F.pow(x, F.lit(i)) * F.col("n")).alias(f"t{i}") for i in range(deg + 1)]).first()
    a = np.array([[sums[f"s{i + j}"] for j in range(deg + 1)] for i in range(deg + 1)])
    coef = np.linalg.solve(a, np.array([sums[f"t{i}"] for i in range(deg + 1)]))
    fit = F.lit(0.0)
    for c in coef[::-1]:
        fit = fit * x + float(c)
    return placed.withColumn("trend", F.greatest(fit, F.lit(0.0)))


def dedupe_rows(df: DataFrame) -> DataFrame:
    """Exact duplicate rows removed (a grouped aggregate, so copies combine before the shuffle)."""
    return df.dropDuplicates()


def most_frequent(df: DataFrame, columns: Sequence[str]) -> dict[str, object]:
    """Commonest non-null value per column, the smallest on ties (in the column's own order); None if there is none.

    One scan keeps a mergeable frequent-items sketch per column, a second one counts just the values the sketches propose.
    A column is settled if its best exact count is above what any other value can have; columns whose values are
    all rare, or of a type the sketch does not order as Spark does (floating point), are counted by value.
    """
    columns = list(dict.fromkeys(columns))
    quoted = {c: "`" + c.replace("`", "``") + "`" for c in columns}  # names may hold dots
    kinds = dict(zip(columns, (f.dataType for f in df.select(*quoted.values()).schema.fields), strict=True))
    sketched = [c for c in columns if isinstance(kinds[c], _SKETCHED)]
    out: dict[str, object] = {}
    if sketched:
        first = df.agg(*[f for i, c in enumerate(sketched) for f in (
            F.expr(f"approx_top_k({quoted[c]}, {PROPOSED}, {TRACKED}) FILTER (WHERE {quoted[c]} IS NOT NULL)").alias(f"s{i}"),
            F.count(quoted[c]).alias(f"n{i}"))]).first()
        proposed = [first[f"s{i}"] or [] for i in range(len(sketched))]
        counts = [F.count_if(F.col(quoted[c]) == F.lit(v["item"])).alias(f"m{i}_{j}")
                  for i, c in enumerate(sketched) for j, v in enumerate(proposed[i])]
        exact = df.agg(*counts).first() if counts else {}
        for i, c in enumerate(sketched):
            # a value left out has at most two of the sketch's errors of 3.5 / TRACKED, or is behind the last one listed
            others = 7.0 * first[f"n{i}"] / TRACKED
            if len(proposed[i]) == PROPOSED:
                others = max(others, proposed[i][-1]["count"])
            found = [(-exact[f"m{i}_{j}"], v["item"]) for j, v in enumerate(proposed[i])]
            if not first[f"n{i}"]:
                out[c] = None
            elif found and -min(found)[0] > others:
                out[c] = min(found)[1]
    for c in columns:
        if c not in out:
            value = F.col(quoted[c])
            top = (df.filter(value.isNotNull()).groupBy(value.alias("value")).agg(F.count("*").alias("m"))
                   .orderBy(F.col("m").desc(), "value").limit(1).collect())
            out[c] = top[0]["value"] if top else None
    return out


def domain_repair(df: DataFrame, column: str, allowed: Sequence, target: str,
                  target_allowed: Sequence = (0, 1)) -> DataFrame:
    """Replace values outside a column's domain by its mode; drop rows with an invalid target."""
    mode = most_frequent(df, [column])[column]
    fixed = F.when(F.coalesce(F.col(column).isin(list(allowed)), F.lit(False)), F.col(column)).otherwise(F.lit(mode))
    return df.withColumn(column, fixed).filter(F.col(target).isin(list(target_allowed)))


def percentile_limits(df: DataFrame, columns: Sequence[str], low: float, high: float) -> dict[str, tuple]:
    return {c: tuple(v) for c, v in quantile_values(df, columns, [low, high]).items()}
