"""Deterministic stratified splits, folds, samples and bootstrap weights, all driven by key hashes."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsight.functions.expressions import hash32
from tabsight.operators.small import joined

CELL_BITS = 16


def hash_positions(df: DataFrame, by: Sequence[str], keys: Sequence[str], seed: str,
                   cell_bits: int = CELL_BITS) -> DataFrame:
    """Add ``_rn`` (1-based position by key hash within ``by``) and ``_n`` (group size).

    A class may hold half of all rows, so it is never sorted as a whole: the hash range is cut into
    ``2**cell_bits`` equal cells, which a uniform hash fills evenly; counts per cell give the offsets and
    rows are numbered inside their cell only.
    """
    by = list(by)
    u = df.withColumn("_u", hash32(seed, *keys)).withColumn("_cell", F.shiftright("_u", 32 - cell_bits))
    before = W.partitionBy(*by).orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)
    cells = (u.groupBy(*by, "_cell").agg(F.count("*").alias("_m"))
             .select(*by, "_cell", F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_before"),
                     F.sum("_m").over(W.partitionBy(*by)).alias("_n")))
    inside = W.partitionBy(*by, "_cell").orderBy("_u", *keys)
    return (joined(u.withColumn("_rn", F.row_number().over(inside)), cells, [*by, "_cell"])
            .withColumn("_rn", F.col("_rn") + F.col("_before")).drop("_u", "_cell", "_before"))


def stratified_split(df: DataFrame, target: str, keys: Sequence[str], *, test_size: float = 0.2, seed: str = "42",
                     name: str = "split") -> DataFrame:
    """'test' for the first ``round(test_size * n)`` rows of every class by key hash, else 'train'."""
    placed = hash_positions(df, [target], keys, seed)
    return placed.withColumn(name, F.when(F.col("_rn") <= F.round(F.col("_n") * test_size), "test")
                             .otherwise("train")).drop("_rn", "_n")


def stratified_folds(df: DataFrame, target: str, keys: Sequence[str], *, k: int = 5, seed: str = "42",
                     name: str = "fold") -> DataFrame:
    """Fold 0..k-1, dealt round-robin within each class by key hash."""
    placed = hash_positions(df, [target], keys, seed)
    return placed.withColumn(name, ((F.col("_rn") - 1) % k).cast("int")).drop("_rn", "_n")


def fold_membership(folded: DataFrame, keys: Sequence[str], k: int, fold: str = "fold") -> DataFrame:
    """(key, fold, part) for every fold: 'val' in the row's own fold, 'train' in the others."""
    return (folded.select(*keys, F.col(fold).alias("_own"), F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias(fold))
            .withColumn("part", F.when(F.col("_own") == F.col(fold), "val").otherwise("train")).drop("_own"))


def oof_integrity(df: DataFrame, *, by: Sequence[str] = ("model",), id: str = "id", fold: str = "fold",
                  p: str = "y_pred", k: int = 5) -> DataFrame:
    """Whether every id is predicted exactly once, without gaps, in all folds."""
    per_id = df.groupBy(*by, id).agg(
        F.count("*").alias("m"), F.sum(F.col(p).isNull().cast("bigint") + F.isnan(p).cast("bigint")).alias("bad"),
        F.collect_set(fold).alias("folds"))
    return per_id.groupBy(*by).agg(
        F.sum("m").alias("rows"), F.count("*").alias("ids"), F.sum("bad").alias("missing_pred"),
        F.count_if(F.col("m") > 1).alias("repeated_ids"),
        F.size(F.array_distinct(F.flatten(F.collect_set("folds")))).alias("folds")).withColumn(
        "complete", (F.col("repeated_ids") == 0) & (F.col("missing_pred") == 0) & (F.col("folds") == k))


def spotlight_sample(df: DataFrame, id: str, n: int = 20, seed: str = "42") -> DataFrame:
    """``n`` rows without replacement: the smallest key hashes (a distributed top-n)."""
    return df.orderBy(hash32(seed, id), id).limit(max(1, n))


def spotlight_ids(df: DataFrame, id: str, ids: DataFrame, n: int = 20, seed: str = "42") -> DataFrame:
    """Rows with the listed ids, unknown ids left out; ``n`` random rows if none is known."""
    wanted = ids.select(F.col(ids.columns[0]).alias(id)).distinct()
    picked = df.join(wanted, id, "left_semi")
    return picked if picked.limit(1).count() else spotlight_sample(df, id, n, seed)


# Multiplier and stride of the 32-bit mixer; steps of the stride per replicate.
MIX, STRIDE, STEPS = 0x45D9F3B, 0x9E3779B1, 128
#: Rates up to this power of two are drawn from a table of the distribution, larger ones from its normal expansion.
TABLE_BITS = 10


def poisson_cuts(rate: float) -> list[int]:
    """Upper bounds of a 32-bit uniform for each Poisson count: count = number of cuts <= u; of rates up to 700."""
    if rate > 700:
        raise ValueError(f"a sampling rate is at most 700, not {rate}")
    return _cuts(rate)


def _cuts(rate: float) -> list[int]:
    if rate <= 0:
        raise ValueError(f"a sampling rate is above 0, not {rate}")
    cuts, total, k = [], 0.0, 0
    while True:
        total += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))
        cut = int(total * 2**32)
        if cut >= 2**32 - 1 or (k > rate and cuts and cut == cuts[-1]):
            return cuts
        cuts.append(cut)
        k += 1


def replicate_uniforms(a: np.ndarray, b: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """A 32-bit uniform for all pairs of rows, by two hash words (down), and steps, ``STEPS`` per replicate (across)."""
    def mixed(x: np.ndarray) -> np.ndarray:
        for _ in range(2):
            x ^= x >> np.uint32(16)
            x *= np.uint32(MIX)
        x ^= x >> np.uint32(16)
        return x

    at = (steps.astype(np.uint64) * np.uint64(STRIDE)).astype(np.uint32)
    return mixed(mixed(a.astype(np.uint32)[:, None] + at) ^ b.astype(np.uint32)[:, None])


def poisson_draws(a: np.ndarray, b: np.ndarray, n: np.ndarray, replicates: np.ndarray, rate: float = 1.0) -> np.ndarray:
    """Sums of ``n`` Poisson counts for rows with hash words ``a`` and ``b`` (down) and replicates (across).

    A sum of Poisson counts is one, so a binary digit of ``n`` takes one draw, whatever its value.
    """
    out, first = np.zeros((len(n), len(replicates)), np.int64), replicates.astype(np.int64) * STEPS
    for j in range(int(n.max(initial=0)).bit_length()):
        rows = np.flatnonzero(n >> j & 1)
        if not len(rows):
            continue
        u, mean = replicate_uniforms(a[rows], b[rows], first + j), rate * 2.0**j
        if j <= TABLE_BITS:
            out[rows] += np.searchsorted(np.array(_cuts(mean), np.uint32), u, "right")
        else:  # the normal quantile's place is taken by a normal variate of two uniforms, with the next term for skew
            v = replicate_uniforms(a[rows], b[rows], first + 64 + j)
            z = np.sqrt(-2.0 * np.log((u + 0.5) / 2.0**32)) * np.cos(2.0 * np.pi * ((v + 0.5) / 2.0**32))
            out[rows] += np.maximum(0, np.rint(mean + np.sqrt(mean) * z + (z * z - 1.0) / 6.0)).astype(np.int64)
    return out


def hash_words(seed: str, keys: Sequence[str | Column]) -> list[Column]:
    """Two independent 32-bit hashes of the keys."""
    return [hash32(seed, *keys, word=i).alias(f"_h{i}") for i in (0, 1)]


def bootstrap_weights(df: DataFrame, keys: Sequence[str], n_boot: int, *, rate: float = 1.0,
                      seed: str = "boot") -> DataFrame:
    """Each row once per replicate that draws it, with ``replicate`` and its Poisson weight ``w``.

    Poisson counts per row stand in for drawing with replacement, which needs no global index. One digest of a row
    serves all its replicates. Callers should aggregate right away: the rows are combined map-side.
    """
    return cell_weights(df.withColumn("_one", F.lit(1).cast("bigint")), keys, "_one", n_boot, rate=rate, seed=seed).drop("_one")


def cell_weights(df: DataFrame, keys: Sequence[str], count: str, n_boot: int, *, rate: float = 1.0,
                 seed: str = "boot") -> DataFrame:
    """``bootstrap_weights`` for rows that stand for ``count`` equal rows each: ``w`` is the sum of their weights."""
    schema = T.StructType([*df.schema.fields, T.StructField("replicate", T.IntegerType()), T.StructField("w", T.LongType())])

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, (1 << 20) // n_boot)
            for k in range(0, batch.num_rows, step):
                part = batch.slice(k, step)
                a, b, n = (np.array(part.column(c), np.int64) for c in ("_h0", "_h1", count))
                w = poisson_draws(a, b, n, np.arange(n_boot), rate)
                row, replicate = np.nonzero(w)
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(row)) for c in part.columns[:-2]), pa.array(replicate.astype(np.int32)), pa.array(w[row, replicate])],
                                                 schema.names)

    return df.select(*df.columns, *hash_words(seed, keys)).mapInArrow(draw, schema)


def bootstrap_counts(df: DataFrame, keys: Sequence[str], n_boot: int, *, rate: float = 1.0,
                     seed: str = "boot") -> DataFrame:
    """Drawn rows, distinct rows and the largest multiplicity per replicate."""
    return (bootstrap_weights(df.select(*keys), keys, n_boot, rate=rate, seed=seed).groupBy("replicate")
            .agg(F.sum("w").alias("drawn"), F.count("*").alias("distinct_rows"), F.max("w").alias("max_copies")))
