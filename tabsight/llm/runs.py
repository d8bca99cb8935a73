"""Repeated windows over whole corpora: runs of windows that share a minimiser.

A window is a fixed number of consecutive elements (words or bytes) of one document. Its minimiser is the smallest
hash of its shorter grams, the first of equal ones. Consecutive windows with the same minimiser gram make a run.
Equal windows have equal minimisers, so a window can only be equal to windows of runs in the same bucket, that is
with the same minimiser; within one run all windows differ.

* Equal runs are recognised by a 128-bit name (the minimiser, and a hash of the first and last window, which
  together cover a run) and need no text.
* A run that repeats itself right behind itself, as in periodic text, is one row with the number of times.
* Only runs that meet different runs in their bucket travel as one packed string each; there all windows are
  sorted by hash, and windows of equal hash are compared byte by byte.
* A bucket with more such runs than ``WIDE`` is spread over the cluster window by window, by 128-bit hash.

A document is addressed by its id and a hash of its text, so repeated or null ids do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabsight.llm.text import slices, spread, string_buffers, words_of
from tabsight.sources.files import materialised

STEP = 1 << 22
SLICE_BYTES = 1 << 20
WIDE = 5_000
CHUNK_BYTES = 1 << 20
PAIRS = 50_000
_MASK = np.uint64((1 << 24) - 1)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def odd(n: int, seed: int) -> np.ndarray:
    """``n`` fixed odd multipliers."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


@dataclass
class Elements:
    """The elements of some texts: bytes between which they lie, texts' offsets, and hashes."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    offsets: np.ndarray
    hashes: np.ndarray
    stride: int

    def grams(self, width: int) -> np.ndarray:
        return self._sum(None, width, 11)

    def windows(self, at: np.ndarray, length: int, seed: int = 17) -> np.ndarray:
        return self._sum(at, length, seed)

    def _sum(self, at: np.ndarray | None, length: int, seed: int) -> np.ndarray:
        """Hash of ``length`` elements from each of the places, or from every place that has room."""
        steps = [*range(0, length - self.stride + 1, self.stride)]
        if steps[-1] + self.stride < length:
            steps.append(length - self.stride)
        factors = odd(len(steps), seed)
        if at is not None:
            total = np.zeros(len(at), np.uint64)
            for k, c in zip(steps, factors, strict=True):
                total += self.hashes[at + k] * c
            return mix(total)
        n = max(0, len(self.hashes) - steps[-1])
        total = np.zeros(n, np.uint64)
        for k, c in zip(steps, factors, strict=True):
            total += self.hashes[k: k + n] * c
        return mix(total)


def word_elements(data: np.ndarray, offsets: np.ndarray) -> Elements:
    starts, ends, own = words_of(data, offsets)
    if not len(starts):
        return Elements(data, starts, ends, own, np.zeros(0, np.uint64), 1)
    size = ends - starts
    at = spread(starts, size)
    place = at - np.repeat(starts, size)
    value = (data[at].astype(np.uint64) + np.uint64(1)) * odd(int(size.max()), 3)[place]
    total = np.add.reduceat(value, np.cumsum(size) - size)
    return Elements(data, starts, ends, own, mix(total + size.astype(np.uint64)), 1)


def byte_elements(data: np.ndarray, offsets: np.ndarray) -> Elements:
    """A byte's hash is that of the eight bytes from there on; those of a text's last seven are never used."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = np.ndarray((len(data),), "<u8", padded, strides=(1,))
    place = np.arange(len(data), dtype=np.int64)
    return Elements(data, place, place + 1, offsets, mix(eight.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)), 8)


@dataclass(frozen=True)
class Kind:
    """What a window is made of: ``unit`` words or bytes, ``length`` of them, grams of ``width``."""

    unit: str
    length: int
    width: int

    def elements(self, data: np.ndarray, offsets: np.ndarray) -> Elements:
        return (word_elements if self.unit == "word" else byte_elements)(data, offsets)


def minimiser_runs(e: Elements, kind: Kind) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and minimiser of every run."""
    length, span = kind.length, kind.length - kind.width + 1
    windows = spread(e.offsets[:-1], np.maximum(0, np.diff(e.offsets) - length + 1))
    grams = e.grams(kind.width) if len(windows) else np.zeros(0, np.uint64)
    firsts, numbers, minimisers = [], [], []
    for low in range(0, len(grams), STEP):
        own = windows[np.searchsorted(windows, low): np.searchsorted(windows, low + STEP)]
        if not len(own):
            continue
        part = grams[low: low + STEP + span - 1]
        least = (part & ~_MASK) | np.arange(len(part), dtype=np.uint64)
        n, size = len(part) - span + 1, 1
        while 2 * size <= span:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        least = np.minimum(least[:n], least[span - size: span - size + n])
        at = (least[own - low] & _MASK).astype(np.int64)
        new = np.ones(len(own), bool)
        new[1:] = (at[1:] != at[:-1]) | (np.diff(own) != 1)
        cut = np.flatnonzero(new)
        firsts.append(own[cut])
        numbers.append(np.diff(np.append(cut, len(own))))
        minimisers.append(part[at[cut]])
    if not firsts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(firsts), np.concatenate(numbers), np.concatenate(minimisers)


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, tkey, body): the address of a document and its text; a null text is empty."""
    body = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(body).alias("tkey"), body.alias("body"))


def _id_type(df: DataFrame) -> str:
    return df.schema["id"].dataType.simpleString()


def runs_of(texts: DataFrame, kind: Kind) -> DataFrame:
    """(mini, run, id, tkey, start, n, times) for every run of every text: it stands there ``times`` times in a row."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = string_buffers(batch.column(2))
            for i, j in slices(offsets, SLICE_BYTES):
                e = kind.elements(data[offsets[i]: offsets[j]], offsets[i: j + 1] - offsets[i])
                first, n, mini = minimiser_runs(e, kind)
                if not len(first):
                    continue
                doc = np.searchsorted(e.offsets, first, "right") - 1
                name = mix(e.windows(first, kind.length) * np.uint64(3) + mix(e.windows(first + n - 1, kind.length)) + n.astype(np.uint64))
                new = np.ones(len(first), bool)
                new[1:] = (mini[1:] != mini[:-1]) | (name[1:] != name[:-1]) | (doc[1:] != doc[:-1]) | (first[1:] != first[:-1] + n[:-1])
                head = np.flatnonzero(new)
                times = np.diff(np.append(head, len(first)))
                first, n, mini, name, doc = (x[head] for x in (first, n, mini, name, doc))
                rows = pa.array(doc + i)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(mini.view(np.int64)), pa.array(name.view(np.int64)), batch.column(0).take(rows), batch.column(1).take(rows),
                     pa.array(first - e.offsets[doc]), pa.array(n), pa.array(times)],
                    ["mini", "run", "id", "tkey", "start", "n", "times"])

    return texts.mapInArrow(parse, f"mini long, run long, id {_id_type(texts)}, tkey long, start long, n long, times long")


def repeated_windows(texts: DataFrame, kind: Kind, earlier: bool, wide: int = WIDE) -> DataFrame:
    """(id, tkey, start, n): stretches of windows that also start in a document with a smaller id (``earlier``;
    null ids are largest), or else anywhere else at all."""
    name, bucket = Window.partitionBy("mini", "run"), Window.partitionBy("mini")
    order = F.coalesce(F.col("id").cast("long"), F.lit(2**63 - 1))
    found = runs_of(texts, kind).repartition("mini")
    if earlier:
        found = found.withColumn("known", order > F.min(order).over(name)).withColumn("open", ~F.col("known"))
    else:
        this = F.struct("id", "tkey", "start")
        found = found.withColumn("known", F.sum("times").over(name) > 1).withColumn("open", ~F.col("known") | (this == F.min(this).over(name)))
    found = (found.withColumn("open", F.col("open") & (F.min("run").over(bucket) != F.max("run").over(bucket)))
             .withColumn("wide", F.sum(F.col("open").cast("long")).over(bucket) > wide)
             .filter("known or open").select("id", "tkey", "start", "n", "times", "mini", "known", "open", "wide"))
    found = materialised(found)
    parts = [found.filter("known").select("id", "tkey", "start", (F.col("n") * F.col("times")).alias("n"))]
    narrow = _packed(texts, found.filter("open and not wide"), kind, order)
    parts.append(_sorted_buckets(narrow.repartition("mini").sortWithinPartitions("mini"), kind, earlier))
    if found.filter("open and wide").limit(1).count():
        parts.append(_spread_buckets(_packed(texts, found.filter("open and wide"), kind, order), kind, earlier))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return materialised(out)


def _lists(rows: DataFrame, *columns: str) -> DataFrame:
    """One row per document with its stretches; a document has no more of them than elements."""
    return rows.groupBy("id", "tkey").agg(F.collect_list(F.struct(*columns)).alias("rows"))


def _with_texts(texts: DataFrame, lists: DataFrame, how: str) -> DataFrame:
    right = lists.select(F.col("id").alias("id2"), F.col("tkey").alias("tkey2"), "rows")
    return texts.join(right, (F.col("tkey") == F.col("tkey2")) & F.col("id").eqNullSafe(F.col("id2")), how).drop("id2", "tkey2")


def _packed(texts: DataFrame, rows: DataFrame, kind: Kind, order: Column) -> DataFrame:
    """(mini, ord, id, tkey, start, n, times, packed): the bytes of each run, its words one space apart."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                data, offsets = string_buffers(one.column("body"))
                e = kind.elements(data, offsets)
                runs = one.column("rows").flatten()
                start, n, mini, times = (runs.field(c).to_numpy(zero_copy_only=False) for c in ("start", "n", "mini", "times"))
                raw = data.tobytes()
                if kind.unit == "word":
                    last = start + n + kind.length - 2
                    packed = [b" ".join(raw[a:b].split()) for a, b in zip(e.starts[start].tolist(), e.ends[last].tolist(), strict=True)]
                else:
                    packed = [raw[a:b] for a, b in zip(start.tolist(), (start + n + kind.length - 1).tolist(), strict=True)]
                same = pa.array(np.zeros(len(start), np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(mini), one.column("ord").take(same), one.column("id").take(same), one.column("tkey").take(same), pa.array(start), pa.array(n), pa.array(times),
                     pa.array(packed, pa.binary())],
                    ["mini", "ord", "id", "tkey", "start", "n", "times", "packed"])

    joined = _with_texts(texts, _lists(rows, "start", "n", "mini", "times"), "inner").withColumn("ord", order)
    return joined.mapInArrow(pack, f"mini long, ord long, id {_id_type(texts)}, tkey long, start long, n long, times long, packed binary")


def _windows(packed: pa.Array, kind: Kind) -> tuple[Elements, np.ndarray, np.ndarray]:
    """Elements, the first element of every window, and the row it is from."""
    data, offsets = string_buffers(packed)
    e = kind.elements(data, offsets)
    counts = np.maximum(0, np.diff(e.offsets) - kind.length + 1)
    return e, spread(e.offsets[:-1], counts), np.repeat(np.arange(len(counts)), counts)


def _classes(e: Elements, at: np.ndarray, kind: Kind) -> tuple[np.ndarray, np.ndarray]:
    """Order of the windows by content, and where a new content starts in that order."""
    hashes = e.windows(at, kind.length)
    order = np.argsort(hashes, kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = hashes[order[1:]] != hashes[order[:-1]]
    raw = e.data.tobytes()
    a, b = e.starts[at], e.ends[at + kind.length - 1]
    equal = np.flatnonzero(~new)
    differ = []
    for low in range(0, len(equal), PAIRS):
        pairs = equal[low: low + PAIRS]
        p, q = order[pairs - 1], order[pairs]
        differ += [k for k, w, x, y, z in zip(pairs.tolist(), a[p].tolist(), b[p].tolist(), a[q].tolist(), b[q].tolist(), strict=True) if raw[w:x] != raw[y:z]]
    if differ:  # two contents with one hash: order those windows by their bytes
        group = np.cumsum(new)
        for g in {int(group[k]) for k in differ}:
            own = np.flatnonzero(group == g)
            content = [raw[a[i]:b[i]] for i in order[own]]
            rank = sorted(range(len(own)), key=content.__getitem__)
            order[own] = order[own][rank]
            for k, (i, j) in enumerate(zip(rank, rank[1:], strict=False), 1):
                new[own[k]] = content[i] != content[j]
    return order, new


def _hits(order: np.ndarray, new: np.ndarray, ids: np.ndarray, earlier: bool) -> np.ndarray:
    """Per window, whether its content also stands in a smaller document, or elsewhere."""
    hit = np.zeros(len(order), bool)
    if len(order):
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(order)))
        hit[order] = ids[order] > np.repeat(np.minimum.reduceat(ids[order], first), size) if earlier else np.repeat(size > 1, size)
    return hit


def _sorted_buckets(packed: DataFrame, kind: Kind, earlier: bool) -> DataFrame:
    """Sort the windows of whole buckets, some megabytes of them at a time."""

    def solve(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        e, at, row = _windows(batch.column("packed"), kind)
        order, new = _classes(e, at, kind)
        hit = np.flatnonzero(_hits(order, new, batch.column("ord").to_numpy()[row], earlier))
        if not len(hit):
            return
        head = np.ones(len(hit), bool)
        head[1:] = (np.diff(hit) != 1) | (row[hit[1:]] != row[hit[:-1]])
        cut = np.flatnonzero(head)
        rows, size = row[hit[cut]], np.diff(np.append(cut, len(hit)))
        start = batch.column("start").to_numpy()[rows] + at[hit[cut]] - e.offsets[rows]
        step, times = (batch.column(c).to_numpy()[rows] for c in ("n", "times"))
        whole = size == step  # then its repetitions make one stretch with it
        size, times = np.where(whole, size * times, size), np.where(whole, 1, times)
        start = np.repeat(start, times) + (spread(np.zeros(len(times), np.int64), times) * np.repeat(step, times))
        take = pa.array(np.repeat(rows, times))
        yield pa.RecordBatch.from_arrays([batch.column("id").take(take), batch.column("tkey").take(take), pa.array(start), pa.array(np.repeat(size, times))],
                                         ["id", "tkey", "start", "n"])

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                part = batch.slice(k, 2000)
                mini = part.column("mini").to_numpy()
                change = np.flatnonzero(mini[1:] != mini[:-1])
                if kept and kept[-1].column("mini")[-1].as_py() != mini[0]:
                    cut = 0
                else:
                    cut = int(change[0]) + 1 if len(change) else None
                if kept and size > CHUNK_BYTES and cut is not None:
                    yield from solve(_together([*kept, part.slice(0, cut)]))
                    kept, size, part = [], 0, part.slice(cut)
                kept.append(part)
                size += part.column("packed").nbytes if part.num_rows else 0
                kept = [x for x in kept if x.num_rows]
        if kept:
            yield from solve(_together(kept))

    return packed.mapInArrow(sort, f"id {_id_type(packed)}, tkey long, start long, n long")


def _together(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def _spread_buckets(packed: DataFrame, kind: Kind, earlier: bool) -> DataFrame:
    """Buckets too large for a task: their windows meet by 128-bit hash."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                e, at, row = _windows(part.column("packed"), kind)
                if not len(at):
                    continue
                rows = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(e.windows(at, kind.length).view(np.int64)), pa.array(e.windows(at, kind.length, 23).view(np.int64)),
                     *(part.column(c).take(rows) for c in ("ord", "id", "tkey", "n", "times")), pa.array(part.column("start").to_numpy()[row] + at - e.offsets[row])],
                    ["h1", "h2", "ord", "id", "tkey", "n", "times", "start"])

    rows = packed.mapInArrow(emit, f"h1 long, h2 long, ord long, id {_id_type(packed)}, tkey long, n long, times long, start long")
    same = Window.partitionBy("h1", "h2")
    hit = F.col("ord") > F.min("ord").over(same) if earlier else F.count(F.lit(1)).over(same) > 1
    found = rows.withColumn("hit", hit).filter("hit").withColumn("turn", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1)))
    return found.select("id", "tkey", (F.col("start") + F.col("n") * F.col("turn")).alias("start"), F.lit(1).cast("long").alias("n"))


def covered(start: np.ndarray, n: np.ndarray, length: int, size: int) -> np.ndarray:
    """Which of a text's ``size`` elements lie in a window of the stretches."""
    edge = np.zeros(size + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + n + length - 1, -1)
    return np.cumsum(edge[:-1]) > 0


def with_stretches(texts: DataFrame, stretches: DataFrame) -> DataFrame:
    """(id, tkey, body, rows): every text with its list of (start, n), null where it has none."""
    return _with_texts(texts, _lists(stretches, "start", "n"), "left")
