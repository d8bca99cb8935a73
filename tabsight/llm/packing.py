"""Best-fit packing of tokenised documents into sequences of a fixed capacity, by large-item matching.

The plan works on counts per length, of which there are at most as many as the capacity: pieces above a third
of the capacity are matched greedily, at most two in a sequence; shorter pieces then go, longest first, where
they leave the smallest gap. A piece finds its place from its rank among the pieces of its length, so neither
tokens nor rows meet in one task.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabsight.llm.encoder import encoder
from tabsight.llm.text import id_column
from tabsight.sources.files import materialised

CAPACITY = 2048


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """Every document's ids with the end id, cut into pieces of at most ``capacity``; the first may be shorter.

    Columns: the id, piece, start, length, ids_crc32, part (the task) and nth (among the task's pieces of that
    length). Null and empty texts are one piece with the end id alone; a null id is kept; repeated rows are
    documents of their own; a very long text is encoded run by run; an empty table gives no rows.
    """
    kind = id_column(docs, id_col).schema[id_col].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        end = np.array([end_id], "<u4")
        for batch in batches:
            row, piece, start, length, crc, nth = [], [], [], [], [], []
            for k, ids in encoder(tokenizer).encode(batch.column(1)):
                ids = np.concatenate((ids.astype("<u4", copy=False), end))
                at = 0
                for i, size in enumerate(_sizes(len(ids), capacity)):
                    row.append(k)
                    piece.append(i)
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(ids[at: at + size]))
                    nth.append(seen[size])
                    seen[size] += 1
                    at += size
            if row:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                     pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array([part] * len(row), pa.int32()),
                     pa.array(np.array(nth, np.int64))],
                    [id_col, "piece", "start", "length", "ids_crc32", "part", "nth"])
        encoder(tokenizer).rest()

    return docs.select(id_col, text_col).mapInArrow(cut, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long, part int, nth long")


def _sizes(n: int, capacity: int) -> list[int]:
    first = n % capacity
    return [first] * (first > 0) + [capacity] * (n // capacity)


def packing_plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Where the pieces of each length go, from their counts alone.

    A row (length, low, high, each, sequence, offset) says: the piece of that length with rank r, low <= r <
    high, lies in sequence + (r - low) // each, at offset + (r - low) % each * length.
    """
    left = {length: n for length, n in counts.items() if n}
    done = dict.fromkeys(left, 0)
    plan: list[tuple[int, int, int, int, int, int]] = []
    gaps: list[tuple[int, int, int]] = []  # (gap, first sequence, number of sequences), sorted
    opened = 0

    def put(length: int, n: int, each: int, sequence: int, offset: int) -> None:
        plan.append((length, done[length], done[length] + n, each, sequence, offset))
        done[length] += n
        left[length] -= n

    def gap(size: int, sequence: int, n: int) -> None:
        if size and n:
            insort(gaps, (size, sequence, n))

    large = sorted(length for length in left if 3 * length > capacity)
    while large:
        top = large[-1]
        if not left[top]:
            large.pop()
            continue
        k = bisect_left(large, capacity - top + 1) - 1
        while k >= 0 and not left[large[k]]:
            large.pop(k)
            k -= 1
        mate = large[k] if k >= 0 else None
        if mate == top and left[top] == 1:  # the last of its length: the next shorter one, if any
            k -= 1
            while k >= 0 and not left[large[k]]:
                large.pop(k)
                k -= 1
            mate = large[k] if k >= 0 else None
        if mate is None:
            n = left[top]
            put(top, n, 1, opened, 0)
            gap(capacity - top, opened, n)
        elif mate == top:
            n = left[top] // 2
            put(top, 2 * n, 2, opened, 0)
            gap(capacity - 2 * top, opened, n)
        else:
            n = min(left[top], left[mate])
            put(top, n, 1, opened, 0)
            put(mate, n, 1, opened, top)
            gap(capacity - top - mate, opened, n)
        opened += n
    for length in sorted((x for x in left if 3 * x <= capacity), reverse=True):
        while left[length]:
            k = bisect_left(gaps, (length,))
            if k == len(gaps):
                n = -(-left[length] // (capacity // length))
                insort(gaps, (capacity, opened, n))
                opened += n
                continue
            size, sequence, n = gaps.pop(k)
            each = size // length
            full = min(n, left[length] // each)
            if full:
                put(length, full * each, each, sequence, capacity - size)
                gap(size - each * length, sequence, full)
            if full < n and left[length]:
                rest = min(left[length], each)
                put(length, rest, rest, sequence + full, capacity - size)
                gap(size - rest * length, sequence + full, 1)
                full += 1
            gap(size, sequence + full, n - full)
    return plan


def place(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to a written table of pieces (columns length, part and nth)."""
    per_task = cut.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    before = per_task.select("part", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # capacity rows at most
    plan = np.array(sorted(packing_plan(counts, capacity)), np.int64).reshape(-1, 6)
    keys = plan[:, 0] << 44 | plan[:, 1]
    columns = [c for c in cut.columns if c not in ("part", "nth")]
    schema = ", ".join(f"`{c}` {cut.schema[c].dataType.simpleString()}" for c in columns)

    def seat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            row = plan[np.searchsorted(keys, length << 44 | rank, "right") - 1]
            nth = rank - row[:, 1]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in columns), pa.array(row[:, 4] + nth // row[:, 3]), pa.array(row[:, 5] + nth % row[:, 3] * length)],
                [*columns, "sequence_id", "offset"])

    ranked = cut.join(before, ["part", "length"]).select(*columns, (F.col("nth") + F.col("before")).alias("rank"))
    return ranked.mapInArrow(seat, f"{schema}, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """Documents to pieces with their places: id, piece, start, length, ids_crc32, sequence_id, offset."""
    return place(materialised(pieces(docs, tokenizer, end_id, capacity, id_col, text_col)), capacity)


def sequences(docs: DataFrame, placed: DataFrame, tokenizer: str, end_id: int = 0, id_col: str = "doc_id",
              text_col: str = "text") -> DataFrame:
    """The packed ids, one row per sequence (sequence_id, ids), for documents with distinct, non-null ids."""
    kind = docs.schema[id_col].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, ids in encoder(tokenizer).encode(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), pa.array([[*ids.tolist(), end_id]], pa.list_(pa.int32()))], [id_col, "ids"])

    tokens = docs.select(id_col, text_col).mapInArrow(encode, f"`{id_col}` {kind}, ids array<int>")
    cut = placed.join(tokens, id_col).select("sequence_id", "offset", F.expr("slice(ids, int(start) + 1, int(length))").alias("ids"))
    return cut.groupBy("sequence_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids"))
