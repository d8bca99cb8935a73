"""Batches of texts as Arrow buffers and numpy arrays, for operators that work inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_SLICE = 4 << 20

# fixed values: the ASCII white space between words
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True


def is_space(data: np.ndarray) -> np.ndarray:
    return _IS_SPACE[data]


def string_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, one after the other, and the n + 1 offsets; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset: column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    return data[offsets[0]: offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = MAX_SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` bytes; a longer text is a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j
        i = j


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every run of non-space bytes, and the n + 1 offsets of the texts' words."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    space = is_space(data)
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    start = ~space
    start[1:] &= space[:-1]
    start[inner] = ~space[inner]
    end = ~space
    end[:-1] &= space[1:]
    end[inner - 1] = ~space[inner - 1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All integers of the ranges ``start .. start + length``, one range after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    out = np.ones(total, np.int64)
    keep = lengths > 0
    s, n = starts[keep].astype(np.int64), lengths[keep].astype(np.int64)
    at = np.concatenate(([0], np.cumsum(n)[:-1]))
    out[at] = s
    out[at[1:]] -= s[:-1] + n[:-1] - 1
    return np.cumsum(out)


def own_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores in front as it takes to be no column of the table."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def all_columns(df: DataFrame) -> list[Column]:
    """The table's columns, whatever their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def id_column(df: DataFrame, name: str) -> DataFrame:
    """The table with ``name`` first, as given; fails early where the column is missing."""
    if name not in df.columns:
        raise ValueError(f"no column {name!r} in {df.columns}")
    return df
