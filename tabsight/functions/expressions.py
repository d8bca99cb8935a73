"""Small column expressions. Everything here stays inside Catalyst; no Python UDFs."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

HASH_RANGE = float(2**32)


def hash32(seed: str, *keys: str | Column, word: Column | int = 0) -> Column:
    """A deterministic 32-bit integer from ``seed:key:key...``.

    It is taken from an md5 digest, so any SQL engine can reproduce it. One digest holds four
    independent 32-bit words; ``word`` picks one of them.
    """
    parts = [F.lit(seed)] + [(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]
    start = (word if isinstance(word, Column) else F.lit(word)) * 8 + 1
    digest = F.md5(F.concat_ws(":", *parts))
    return F.conv(F.substring(digest, start, F.lit(8)), 16, 10).cast("bigint")


def finite(c: str | Column) -> Column:
    """The value as a double, with NaN and infinities turned into NULL and -0.0 into 0.0."""
    x = (F.col(c) if isinstance(c, str) else c).cast("double") + F.lit(0.0)
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def clamp(c: str | Column, low: float | None, high: float | None) -> Column:
    """Limit a value to ``[low, high]``; NULL stays NULL and the column's type is kept by the caller."""
    x = F.col(c) if isinstance(c, str) else c
    out = x
    if low is not None:
        out = F.when(x < low, F.lit(low)).otherwise(out)
    if high is not None:
        out = F.when(x > high, F.lit(high)).otherwise(out)
    return out


def ratio(num: Column, den: Column) -> Column:
    """``num / den`` as a double, 0 where the denominator is 0."""
    return F.when(den == 0, F.lit(0.0)).otherwise(num.cast("double") / den.cast("double"))


def bin_right_closed(c: str | Column, edges: Sequence[float], include_lowest: bool = False) -> Column:
    """Index of the ``(edge_i, edge_{i+1}]`` interval holding the value, NULL outside all of them."""
    x = F.col(c) if isinstance(c, str) else c
    out: Column | None = None
    for i, (lo, hi) in enumerate(zip(edges[:-1], edges[1:])):
        above = (x >= lo) if (i == 0 and include_lowest) else (x > lo)
        hit = above & (x <= hi)
        out = F.when(hit, F.lit(i)) if out is None else out.when(hit, F.lit(i))
    return out


def recode(c: str | Column, levels: Mapping[int, int], default: int) -> Column:
    """Map listed levels to codes; anything else, NULL included, becomes ``default``."""
    x = F.col(c) if isinstance(c, str) else c
    out = None
    for level, code in levels.items():
        out = F.when(x == level, F.lit(code)) if out is None else out.when(x == level, F.lit(code))
    return out.otherwise(F.lit(default))


def band(c: str | Column, steps: Iterable[tuple[float, bool, str]], last: str) -> Column:
    """Label by increasing upper bounds: ``(bound, inclusive, label)``, then ``last``. NULL gives NULL."""
    x = F.col(c) if isinstance(c, str) else c
    out = F.when(x.isNull(), F.lit(None).cast("string"))
    for bound, inclusive, label in steps:
        out = out.when((x <= bound) if inclusive else (x < bound), F.lit(label))
    return out.otherwise(F.lit(last))


def round_half_up(c: str | Column, digits: int = 6) -> Column:
    """``round``, but through the slow decimal arithmetic only near a tie and for very large numbers.

    Elsewhere the nearest whole number of units, divided by their exact number, is the same double.
    """
    x = F.col(c).cast("double") if isinstance(c, str) else c
    units = x * F.lit(10.0**digits)
    sure = (F.abs(units) < 2.0**40) & (F.abs(units - F.rint(units)) < 0.499)
    return F.when(sure, F.rint(units) / F.lit(10.0**digits) + F.lit(0.0)).otherwise(F.round(x, digits))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every floating column, so that two engines' summation orders compare equal."""
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    if not doubles:
        return df
    return df.withColumns({c: round_half_up(c, digits) for c in doubles})


def melt(df: DataFrame, keys: Sequence[str], columns: Sequence[str], name: str = "column",
         value: str = "value", cast: str = "double") -> DataFrame:
    """Wide to long: one row per listed column, all cast to one type."""
    kept = df.select(*keys, *[F.col(c).cast(cast).alias(c) for c in columns])
    return kept.unpivot(list(keys), list(columns), name, value)
