"""Quality classifier: a generalised additive model with pairwise interactions.

Statistics of a text are binned at quantiles. Training goes round the statistics again and again; each turn fits a
shallow tree to the gradient over one statistic's bins and adds a small part of it to that statistic's lookup
table. Pairs of statistics that still explain the gradient then get tables of their own in the same way. A score is
the logistic of a sum of table entries, so that whole batches are scored by additions of looked-up bins.

Training takes labelled rows up to a bound, chosen by a hash of their id; everything else reads whole tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsight.llm.runs import word_elements
from tabsight.llm.text import id_column, slices, string_buffers

#: Labelled rows that training reads at most.
SAMPLE = 30_000
BINS = 48
PAIR_BINS = 8
ROUNDS = 120
PAIR_ROUNDS = 40
PAIRS = 6
RATE = 0.2
SMOOTH = 4.0

FEATURES = ("log_words", "log_bytes", "word_bytes", "upper", "digit", "symbol", "pipe", "exclaim", "stop", "comma", "other_mark", "high",
            "newline", "words_line", "again", "distinct", "distinct_pairs", "distinct_triples", "dup_lines", "long_word")

_CLASSES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "symbol": b"#*$%&<>@^~_=+\\{}[]", "pipe": b"|",
            "exclaim": b"!?", "stop": b".", "comma": b",;:", "other_mark": b"'\"()-/`", "newline": b"\n"}


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts, FEATURES) of texts given as bytes; an empty text has zeros."""
    n = len(offsets) - 1
    e = word_elements(data, offsets)
    words = np.diff(e.offsets).astype(float)
    size = np.diff(offsets).astype(float)
    some, per_word = np.maximum(size, 1), np.maximum(words, 1)
    doc = np.repeat(np.arange(n), np.diff(e.offsets))

    def count(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(mask)))
        return np.diff(total[offsets]).astype(float)

    kind = np.zeros(256, np.uint8)
    for k, chars in enumerate(_CLASSES.values(), 1):
        kind[list(chars)] = k
    kinds = kind[data]
    out = {name: count(kinds == k) for k, name in enumerate(_CLASSES, 1)}
    lines = out["newline"] + 1
    for name in _CLASSES:
        out[name] = out[name] / (some if name in ("upper", "digit", "newline") else per_word)
    out |= {"log_words": np.log1p(words), "log_bytes": np.log1p(size), "high": count(data >= 0x80) / some, "words_line": np.log1p(words / lines)}
    length = (e.ends - e.starts).astype(float)
    out["word_bytes"] = np.bincount(doc, length, n) / per_word
    out["long_word"] = np.bincount(doc, length > 12, n) / per_word
    h = e.hashes
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    out["again"] = np.bincount(doc, same, n) / per_word
    for width, name in ((1, "distinct"), (2, "distinct_pairs"), (3, "distinct_triples")):
        grams = e.grams(width) if len(h) >= width else np.zeros(0, np.uint64)
        own = doc[: len(grams)]
        inside = own == doc[width - 1: width - 1 + len(own)]
        out[name] = _distinct(grams[inside], own[inside], n) / np.maximum(words - width + 1, 1)
    starts = np.concatenate((offsets[:-1], np.flatnonzero(data == 10) + 1))
    starts = np.unique(starts[starts < len(data)])
    out["dup_lines"] = 1 - _distinct_lines(e, starts, offsets, n) / np.maximum(lines, 1)
    return np.stack([out[f] for f in FEATURES], 1)


def _distinct(values: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Number of different values of each text."""
    if not len(values):
        return np.zeros(n)
    key = values ^ (doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, first = np.unique(key, return_index=True)
    return np.bincount(doc[first], minlength=n).astype(float)


def _distinct_lines(e, starts: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """Number of different lines with words of each text, by a hash of their words in order."""
    if not len(e.hashes):
        return np.zeros(n)
    line = np.searchsorted(starts, e.starts, "right") - 1
    head = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1])))
    place = np.arange(len(line)) - np.repeat(head, np.diff(np.append(head, len(line))))
    total = np.add.reduceat(e.hashes * (2 * place + 1).astype(np.uint64), head)
    doc = np.searchsorted(offsets, e.starts[head], "right") - 1
    return _distinct(total, doc, n)


@dataclass
class AdditiveModel:
    """Quantile edges, lookup tables per statistic and per pair, and the intercept."""

    edges: list[np.ndarray]
    base: float
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        for j, table in enumerate(self.tables):
            z += table[np.searchsorted(self.edges[j], x[:, j], "right")]
        coarse = {j: np.searchsorted(self.pair_edges[j], x[:, j], "right") for pair in self.pairs for j in pair}
        for (i, j), table in zip(self.pairs, self.pair_tables, strict=True):
            z += table[coarse[i], coarse[j]]
        return 1 / (1 + np.exp(-z))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.arange(1, bins) / bins, method="lower"))


def _best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Gain of the best cut of a line of bins, and where its right side starts."""
    if len(g) < 2:
        return 0.0, 0
    a, b = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    total = g.sum() ** 2 / (h.sum() + SMOOTH)
    gain = a**2 / (b + SMOOTH) + (g.sum() - a) ** 2 / (h.sum() - b + SMOOTH) - total
    k = int(np.argmax(gain))
    return float(gain[k]), k + 1


def _line_tree(g: np.ndarray, h: np.ndarray, leaves: int = 4) -> np.ndarray:
    """Values per bin of a tree that cuts the line of bins where it gains most."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        cuts = [(*_best_cut(g[a:b], h[a:b]), a, b) for a, b in parts]
        gain, k, a, b = max(cuts)
        if gain <= 1e-12:
            break
        parts.remove((a, b))
        parts += [(a, a + k), (a + k, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + SMOOTH)
    return out


def _grid_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and values of the best tree that cuts one axis of a grid, then each side on the other."""
    best = (0.0, np.zeros_like(g))
    for turned in (False, True):
        gg, hh = (g.T, h.T) if turned else (g, h)
        for k in range(1, len(gg)):
            out, gain = np.zeros_like(gg), -(g.sum() ** 2) / (h.sum() + SMOOTH)
            for side in (slice(0, k), slice(k, None)):
                a, b = gg[side].sum(0), hh[side].sum(0)
                _, cut = _best_cut(a, b)
                for part in (slice(0, cut), slice(cut, None)):
                    if b[part].size:
                        gain += a[part].sum() ** 2 / (b[part].sum() + SMOOTH)
                        out[side, part] = a[part].sum() / (b[part].sum() + SMOOTH)
            if gain > best[0] + 1e-12:
                best = (float(gain), out.T if turned else out)
    return best


def fit(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, pair_rounds: int = PAIR_ROUNDS, pairs: int = PAIRS) -> AdditiveModel:
    """A model of labels 0 and 1; with one label, or none, it scores all rows by their share."""
    width = x.shape[1]
    share = (y.sum() + 1) / (len(y) + 2)
    edges = [_edges(x[:, j], BINS) if len(x) else np.zeros(0) for j in range(width)]
    model = AdditiveModel(edges, float(np.log(share / (1 - share))), [np.zeros(len(e) + 1) for e in edges])
    if not len(y) or y.min() == y.max():
        return model
    bins = [np.searchsorted(edges[j], x[:, j], "right") for j in range(width)]
    z = np.full(len(y), model.base)
    for _ in range(rounds):
        for j in range(width):
            p = 1 / (1 + np.exp(-z))
            g, h = np.bincount(bins[j], y - p, len(edges[j]) + 1), np.bincount(bins[j], p * (1 - p), len(edges[j]) + 1)
            step = RATE * _line_tree(g, h)
            model.tables[j] += step
            z += step[bins[j]]
    model.pair_edges = [_edges(x[:, j], PAIR_BINS) for j in range(width)]
    coarse = [np.searchsorted(model.pair_edges[j], x[:, j], "right") for j in range(width)]
    shape = {j: len(model.pair_edges[j]) + 1 for j in range(width)}

    def grids(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-z))
        cell, n = coarse[i] * shape[j] + coarse[j], shape[i] * shape[j]
        return np.bincount(cell, y - p, n).reshape(shape[i], shape[j]), np.bincount(cell, p * (1 - p), n).reshape(shape[i], shape[j])

    gains = sorted(((_grid_tree(*grids(i, j))[0], -i, -j) for i, j in combinations(range(width), 2)), reverse=True)
    model.pairs = [(-i, -j) for gain, i, j in gains[:pairs] if gain > 0]
    model.pair_tables = [np.zeros((shape[i], shape[j])) for i, j in model.pairs]
    for _ in range(pair_rounds):
        for k, (i, j) in enumerate(model.pairs):
            step = RATE * _grid_tree(*grids(i, j))[1]
            model.pair_tables[k] += step
            z += step[coarse[i], coarse[j]]
    return model


def fold(id_col: str, folds: int = 5):
    """crc32 of the id as text, modulo; a null id has none."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds))


def text_features(docs: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """(id, the further columns, x) with x the FEATURES of every whole text; a null text is empty."""
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in (id_col, *more))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, x in _batch_features(batch.column(batch.num_columns - 1)):
                part = batch.slice(low, len(x))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(list(x), pa.list_(pa.float64()))], [id_col, *more, "x"])

    return docs.select(id_col, *more, text_col).mapInArrow(make, f"{kinds}, x array<double>")


def _batch_features(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    data, offsets = string_buffers(column)
    for i, j in slices(offsets, 2 << 20):
        yield i, features(data[offsets[i]: offsets[j]], offsets[i: j + 1] - offsets[i])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
          sample: int = SAMPLE) -> AdditiveModel:
    """Fit on at most ``sample`` labelled rows whose fold is not 0; labels other than 0 and 1 are left out."""
    known = (labels.filter(F.col(label_col).isin(0, 1) & (fold(id_col) != 0)).groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).cast("int").alias("__y"))
             .orderBy(F.xxhash64("__id"), "__id").limit(sample))
    chosen = docs.select(F.col(id_col), F.col(text_col).alias("__text")).join(F.broadcast(known), F.col(id_col) == F.col("__id"))  # at most ``sample`` rows
    rows = text_features(chosen, id_col, "__text", "__y").dropDuplicates([id_col]).collect()
    rows.sort(key=lambda r: r[id_col])
    x = np.array([r["x"] for r in rows], float).reshape(-1, len(FEATURES))
    return fit(x, np.array([r["__y"] for r in rows], float))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
             threshold: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    """(id, held_out, score, predicted) for every document; score is the estimated chance of label 1.

    Null, empty and blank texts are scored like any text; a null id is scored and never held out; repeated rows
    score alike, repeated labels count once (as 1 if they differ); an empty table gives no rows, and without labels
    all scores are one half. Columns other than id, text and label are not read.
    """
    model = train(id_column(docs, id_col), labels, id_col, text_col, label_col, sample)
    kind = docs.schema[id_col].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, x in _batch_features(batch.column(2)):
                part = batch.slice(low, len(x))
                p = model.score(x)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(p), pa.array((p >= threshold).astype(np.int32))],
                                                 [id_col, "held_out", "score", "predicted"])

    held = F.coalesce(fold(id_col) == 0, F.lit(False)).alias("held_out")
    return docs.select(id_col, held, text_col).mapInArrow(score, f"`{id_col}` {kind}, held_out boolean, score double, predicted int")
