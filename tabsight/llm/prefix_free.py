"""Repeated byte windows by prefix-free parsing.

* **Phrases.** A hash rolls over the bytes; wherever it is divisible by ``every``, the ``width`` bytes there are a
  trigger. A phrase reaches from the start of a trigger to the end of the next. Where a text has phrases depends on its
  bytes alone, so equal windows are cut alike, and no phrase is a proper prefix of another.
* **Dictionary.** Distinct phrases are counted over the corpus. No repeated window holds a phrase that occurs once, so
  the parse breaks there: only windows between such phrases go on. (Two phrases of one hash only keep more windows.)
* **Parse.** Windows with one first trigger are a stretch of suffixes of the phrase before it, all followed by the same
  suffix of the parse. Equal stretches are one class; the addresses of a class with two members are settled.
* **Order.** What is left meets where its parse suffixes have a common beginning, a range of the corpus order.
  There the phrases are ranked, the parse suffixes are sorted by ranks, and the phrases' suffixes by their bytes from
  the end. Both orders have arrays of common lengths with the neighbour: two windows with ``b`` bytes before their first
  trigger are equal if no such length between them is below ``b`` in the one and ``length - b`` in the other.
* A range with more than ``wide`` stretches, and windows without a trigger, are suffixes that no single task should
  sort: they meet window by window, by 128-bit hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsight.llm.runs import Elements, Kind, _id_type, _lists, _packed, _together, _windows, _with_texts, byte_elements, mix
from tabsight.llm.text import slices, spread, string_buffers
from tabsight.sources.files import discard, materialised

EVERY = 64
SLICE_BYTES = 1 << 20
CHUNK_BYTES = 1 << 20
WIDE = 5_000


def triggers(e: Elements, width: int, every: int) -> tuple[np.ndarray, np.ndarray]:
    """Start of every trigger that lies whole in its text, and the text's number."""
    grams = e.grams(width)
    at = np.flatnonzero((grams >> np.uint64(16)) % np.uint64(every) == 0)
    doc = np.searchsorted(e.offsets, at, "right") - 1
    whole = at + width <= e.offsets[doc + 1]
    return at[whole], doc[whole]


def phrases(texts: DataFrame, length: int, width: int, every: int) -> DataFrame:
    """(name, id, tkey, start) of every phrase that a window can hold."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = string_buffers(batch.column(2))
            for i, j in slices(offsets, SLICE_BYTES):
                e = byte_elements(data[offsets[i]: offsets[j]], offsets[i: j + 1] - offsets[i])
                at, doc = triggers(e, width, every)
                k = np.flatnonzero((doc[1:] == doc[:-1]) & (np.diff(at) + width <= length))
                total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(e.hashes, dtype=np.uint64)))
                start, end = at[k], at[k + 1] + width
                name = mix(total[end - 7] - total[start] + (end - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                rows = pa.array(doc[k] + i)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(name.view(np.int64)), batch.column(0).take(rows), batch.column(1).take(rows), pa.array((start - e.offsets[doc[k]]).astype(np.int32))],
                    ["name", "id", "tkey", "start"])

    return texts.mapInArrow(cut, f"name long, id {_id_type(texts)}, tkey long, start int")


def single_phrases(found: DataFrame) -> DataFrame:
    """(id, tkey, start) of the phrases that occur once."""
    one = found.groupBy("name").agg(F.count(F.lit(1)).alias("n"), *(F.first(c).alias(c) for c in ("id", "tkey", "start")))
    return one.filter("n = 1").select("id", "tkey", "start")


def stretches(e: Elements, single: np.ndarray, length: int, width: int, every: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows, meeting place and whether there is a trigger, of every stretch.

    ``single`` are the starts of phrases that occur once, ascending.
    """
    at, doc = triggers(e, width, every)
    ends = e.offsets[1:]
    before = np.full(len(at), -1, np.int64)
    before[1:] = np.where(doc[1:] == doc[:-1], at[:-1], -1)
    low = np.maximum(np.maximum(before + 1, e.offsets[doc]), at + width - length)
    high = np.minimum(at, ends[doc] - length)
    if len(single):
        k = np.searchsorted(single, at)
        there = np.flatnonzero(k < len(single))
        after = np.searchsorted(at, single[k[there]]) + 1
        same = doc[after] == doc[there]
        high[there[same]] = np.minimum(high[there[same]], at[after[same]] + width - length - 1)
    out = []
    near, room = 0, length // 2
    while True:  # windows with at most length - room bytes before the trigger share room bytes behind it
        room = max(room, width)
        a, z = np.maximum(low, at - (length - room)), np.minimum(high, at - near)
        own = np.flatnonzero(a <= z)
        place = mix(e.windows(at[own], room) + np.uint64(room))
        out.append((a[own], z[own] - a[own] + 1, place, np.ones(len(own), bool)))
        if room == width:
            break
        near, room = length - room + 1, room // 2
    # windows without a trigger: between a trigger's start and the next one's end, or the text's ends
    head = np.concatenate((e.offsets[:-1], at + 1))
    text = np.concatenate((np.arange(len(ends)), doc))
    order = np.lexsort((head, text))
    head, text = head[order], text[order]
    limit = ends[text]
    inner = np.flatnonzero(text[1:] == text[:-1])
    limit[inner] = np.minimum(limit[inner], head[inner + 1] - 1 + width - 1)
    many = np.maximum(0, limit - length - head + 1)
    pieces = -(-many // length)
    first = spread(np.zeros(len(pieces), np.int64), pieces) * length + np.repeat(head, pieces)
    n = np.minimum(length, np.repeat(head + many, pieces) - first)
    out.append((first, n, e.windows(first, length), np.zeros(len(first), bool)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def parse(texts: DataFrame, kind: Kind, every: int) -> DataFrame:
    """(mini, run, anchored, id, tkey, start, n): the stretches of windows that hold no phrase occurring once."""
    length, width = kind.length, kind.width
    single = _lists(single_phrases(phrases(texts, length, width, every)), "start")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = string_buffers(batch.column("body"))
            rows = batch.column("rows")
            for i, j in slices(offsets, SLICE_BYTES):
                e = byte_elements(data[offsets[i]: offsets[j]], offsets[i: j + 1] - offsets[i])
                own = rows.slice(i, j - i)
                size = np.array([0 if x is None else x for x in own.value_lengths().to_pylist()], np.int64)
                at = own.flatten().field("start").to_numpy(zero_copy_only=False).astype(np.int64)
                first, n, mini, anchored = stretches(e, np.sort(at + np.repeat(e.offsets[:-1], size)), length, width, every)
                if not len(first):
                    continue
                doc = np.searchsorted(e.offsets, first, "right") - 1
                run = mix(e.windows(first, length) * np.uint64(3) + mix(e.windows(first + n - 1, length)) + n.astype(np.uint64))
                take = pa.array(doc + i)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(mini.view(np.int64)), pa.array(run.view(np.int64)), pa.array(anchored), batch.column("id").take(take),
                     batch.column("tkey").take(take), pa.array(first - e.offsets[doc]), pa.array(n.astype(np.int64))],
                    ["mini", "run", "anchored", "id", "tkey", "start", "n"])

    joined = _with_texts(texts, single, "left").select("id", "tkey", "body", "rows")
    return joined.mapInArrow(cut, f"mini long, run long, anchored boolean, id {_id_type(texts)}, tkey long, start long, n long")


def repeated_windows(texts: DataFrame, kind: Kind, every: int = EVERY, wide: int = WIDE) -> DataFrame:
    """(id, tkey, start, n): stretches of byte windows that also start elsewhere."""
    found = materialised(parse(texts, kind, every))
    key = ["mini", "run", "anchored"]
    classes = materialised(found.groupBy(*key).agg(F.count(F.lit(1)).alias("members"), *(F.first(c).alias(c) for c in ("id", "tkey", "start", "n"))))
    settled = found.join(classes.filter("members > 1").select(*key), key).select("id", "tkey", "start", "n")
    places = classes.filter("anchored").groupBy("mini").agg(F.count(F.lit(1)).alias("size"))
    narrow = classes.filter("anchored").join(places.filter(f"size > 1 AND size <= {wide}"), "mini")
    broad = (classes.filter("NOT anchored").withColumn("size", F.lit(0).cast("long"))
             .unionByName(classes.filter("anchored").join(places.filter(f"size > {wide}"), "mini").select(*classes.columns, "size")))
    parts = [settled, _ordered(_bytes(texts, narrow, kind).repartition("mini").sortWithinPartitions("mini"), kind, every)]
    if broad.limit(1).count():
        parts.append(_by_hash(_bytes(texts, broad, kind), kind))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    out = materialised(out)
    discard(found, classes)
    return out


def _bytes(texts: DataFrame, rows: DataFrame, kind: Kind) -> DataFrame:
    """The bytes of each class's stretch."""
    rows = rows.select("id", "tkey", "start", "n", "mini", F.lit(1).cast("long").alias("times"))
    return _packed(texts, rows, kind, F.lit(0).cast("long")).select("mini", "id", "tkey", "start", "n", "packed")


def parse_order(e: Elements, anchor: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """The rows by the text from their anchor on: their phrases are ranked, then sequences of ranks are sorted."""
    raw, ends = e.data.tobytes(), e.offsets[1:]
    row = np.searchsorted(e.offsets, at, "right") - 1
    last = np.ones(len(at), bool)
    last[:-1] = row[1:] != row[:-1]
    stop = np.append(at[1:], 0) + width
    stop[last] = ends[row[last]]
    content = [raw[a:b] for a, b in zip(at.tolist(), stop.tolist(), strict=True)]
    rank = {c: k for k, c in enumerate(sorted(set(content)))}
    ranks = np.array([rank[c] for c in content], ">u4").tobytes()
    first = np.searchsorted(at, e.offsets[:-1] + anchor)
    size = np.searchsorted(at, ends) - first
    keys = [ranks[4 * a: 4 * (a + n)] for a, n in zip(first.tolist(), size.tolist(), strict=True)]
    return np.array(sorted(range(len(keys)), key=keys.__getitem__), np.int64)


def common(rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Length of the common beginning of each row of a byte matrix with the row before; -1 for the first."""
    out = np.full(len(rows), -1, np.int64)
    differ = rows[1:] != rows[:-1]
    same = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1]) if rows.shape[1] else np.zeros(len(rows) - 1, np.int64)
    out[1:] = np.minimum(same, np.minimum(sizes[1:], sizes[:-1]))
    return out


def repeated_in_order(e: Elements, n: np.ndarray, kind: Kind, every: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, window) of the windows that equal another one, by the orders of phrase suffixes and parse suffixes."""
    length, count = kind.length, len(n)
    at, _ = triggers(e, kind.width, every)
    base = e.offsets[:-1]
    anchor = at[np.searchsorted(at, base)] - base
    least, size = anchor - n + 1, np.diff(e.offsets)
    padded = np.concatenate((e.data, np.zeros(length, np.uint8)))

    forward = parse_order(e, anchor, at, kind.width)
    lcp = common(padded[(base + anchor)[forward][:, None] + np.arange(length)], (size - anchor)[forward])
    raw = e.data.tobytes()
    left = [raw[a: a + k][::-1] for a, k in zip(base.tolist(), anchor.tolist(), strict=True)]
    backward = np.array(sorted(range(count), key=left.__getitem__), np.int64)
    most = int(anchor.max())
    reach = (base + anchor)[backward][:, None] - 1 - np.arange(most)
    lcs = common(padded[np.maximum(reach, 0)], anchor[backward])

    f, c = np.empty(count, np.int64), np.empty(count, np.int64)
    f[forward] = c[backward] = np.arange(count)
    place = np.arange(count)
    rows, windows = [], []
    for b in range(int(least.min()), most + 1):
        own = np.flatnonzero((least <= b) & (b <= anchor))
        if len(own) < 2:
            continue
        behind = np.maximum.accumulate(np.where(lcp < length - b, place, 0))[f[own]]
        ahead = np.maximum.accumulate(np.where(lcs < b, place, 0))[c[own]]
        _, group, members = np.unique(ahead * count + behind, return_inverse=True, return_counts=True)
        hit = own[members[group] > 1]
        rows.append(hit)
        windows.append(anchor[hit] - b)
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    rows, windows = np.concatenate(rows), np.concatenate(windows)
    order = np.lexsort((windows, rows))
    return rows[order], windows[order]


def _ordered(packed: DataFrame, kind: Kind, every: int) -> DataFrame:
    """Settle whole ranges of the corpus order, about a megabyte of them at a time."""

    def solve(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch = _together(parts)
        data, offsets = string_buffers(batch.column("packed"))
        rows, windows = repeated_in_order(byte_elements(data, offsets), batch.column("n").to_numpy(), kind, every)
        if not len(rows):
            return
        head = np.ones(len(rows), bool)
        head[1:] = (rows[1:] != rows[:-1]) | (np.diff(windows) != 1)
        cut = np.flatnonzero(head)
        take = pa.array(rows[cut])
        yield pa.RecordBatch.from_arrays(
            [batch.column("id").take(take), batch.column("tkey").take(take), pa.array(batch.column("start").to_numpy()[rows[cut]] + windows[cut]),
             pa.array(np.diff(np.append(cut, len(rows))))], ["id", "tkey", "start", "n"])

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        size, last = 0, None
        for batch in batches:
            mini = batch.column("mini").to_numpy()
            cuts = [0, *(np.flatnonzero(mini[1:] != mini[:-1]) + 1).tolist(), len(mini)]
            sizes = np.diff(string_buffers(batch.column("packed"))[1])
            begin = 0
            for a, z in zip(cuts, cuts[1:], strict=False):
                if mini[a] != last and size > CHUNK_BYTES:
                    if a > begin:
                        kept.append(batch.slice(begin, a - begin))
                    yield from solve(kept)
                    kept, size, begin = [], 0, a
                size, last = size + int(sizes[a:z].sum()), mini[a]
            if len(mini) > begin:
                kept.append(batch.slice(begin))
        if kept:
            yield from solve(kept)

    return packed.mapInArrow(sort, f"id {_id_type(packed)}, tkey long, start long, n long")


def _by_hash(packed: DataFrame, kind: Kind) -> DataFrame:
    """Windows meet one by one, by two hashes of 64 bits; counted before they are shuffled."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                e, at, row = _windows(part.column("packed"), kind)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(e.windows(at, kind.length).view(np.int64)), pa.array(e.windows(at, kind.length, 23).view(np.int64)),
                     part.column("id").take(take), part.column("tkey").take(take), pa.array(part.column("start").to_numpy()[row] + at - e.offsets[row])],
                    ["h1", "h2", "id", "tkey", "start"])

    rows = materialised(packed.mapInArrow(emit, f"h1 long, h2 long, id {_id_type(packed)}, tkey long, start long"))
    twice = rows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("members")).filter("members > 1").select("h1", "h2")
    return rows.join(twice, ["h1", "h2"]).select("id", "tkey", "start", F.lit(1).cast("long").alias("n"))
