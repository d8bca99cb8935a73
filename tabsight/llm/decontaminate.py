"""Benchmark decontamination: one Aho-Corasick automaton over normalised test questions and answers.

Texts are lower-cased (A-Z) and their words are runs of a-z, 0-9 and everything beyond ASCII. A pattern is a
window of 13 words of an item, or the whole item if it has fewer; the automaton finds all patterns in one pass
over a text, and the words it hits are mapped back to offsets in the text as it was.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsight.llm.text import all_columns, id_column

WINDOW = 13

#: Bytes of benchmark text in one automaton; more text is scanned for in blocks, one after the other.
BLOCK_BYTES = 16 << 20

#: Other bytes than a-z, 0-9 and those beyond ASCII become spaces, A-Z become a-z.
NORMAL = bytes(b if b >= 0x80 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))

SEEN = "__body string, items array<string>, ranges array<array<int>>"
SCHEMA = "n_words long, n_hit long, items array<string>, spans array<struct<start:int,end:int>>"

_automata: dict[tuple, tuple] = {}


def _named_first(item: str | None) -> tuple[bool, str]:
    return item is None, item or ""


def normal_words(text: bytes) -> list[bytes]:
    return text.translate(NORMAL).split()


def patterns(items: list[tuple[str | None, str]], window: int = WINDOW) -> dict[bytes, set[str | None]]:
    """Pattern to the items that hold it; items without words have none."""
    out: dict[bytes, set[str | None]] = {}
    for item, text in items:
        words = normal_words((text or "").encode())
        for k in range(max(len(words) - window + 1, min(1, len(words)))):
            out.setdefault(b" ".join(words[k: k + window]), set()).add(item)
    return out


def automaton(items: tuple[tuple[str | None, str], ...], window: int):
    """The worker's automaton over the items, built once."""
    key = (items, window)
    if key not in _automata:
        import ahocorasick

        _automata.clear()
        found = ahocorasick.Automaton()
        for pattern, owners in patterns(list(items), window).items():
            found.add_word(f" {pattern.decode('latin-1')} ", (pattern.count(b" ") + 1, sorted(owners, key=_named_first)))
        if len(found):
            found.make_automaton()
        _automata[key] = (found,)
    return _automata[key][0]


def _merged(ranges: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _spans(text: bytes, ranges: list[list[int]]) -> list[dict[str, int]]:
    """Character offsets in the text of ranges of word numbers."""
    data = np.frombuffer(text.translate(NORMAL), np.uint8)
    word = np.concatenate(([0], data != 32, [0])).astype(np.int8)
    edge = np.diff(word)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    char = np.concatenate(([0], np.cumsum(np.frombuffer(text, np.uint8) & 0xC0 != 0x80)))
    return [{"start": int(char[starts[a]]), "end": int(char[ends[b - 1]])} for a, b in ranges]


def item_blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int,
                unnamed: bool = False) -> list[tuple[tuple[str | None, str], ...]]:
    """The benchmark's items, in blocks of about ``block_bytes`` of text; null texts are left out, null ids unless ``unnamed``."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("body")).dropna(
        subset=["body"] if unnamed else ["item", "body"])
    total = items.agg(F.coalesce(F.sum(F.octet_length("body")), F.lit(0)).alias("n")).first()["n"]
    n = max(1, -(-2 * total // block_bytes)) if total > block_bytes else 1
    block = F.pmod(F.xxhash64("item", "body"), F.lit(n))
    return [tuple(sorted(((r["item"], r["body"]) for r in items.filter(block == b).collect()),
                         key=lambda x: (_named_first(x[0]), x[1]))) for b in range(n)]


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW,
                  block_bytes: int = BLOCK_BYTES, carry: tuple[str, ...] = (), unnamed: bool = False) -> DataFrame:
    """(id, the carried columns, n_words, n_hit, items, spans) for every document.

    items are those with occurring patterns, spans the hit stretches as character offsets. Other columns are not
    read. Null, empty and blank texts have no words; a null id is kept; repeated rows are judged one by one; items
    that are equal are all named; an empty benchmark hits nothing; an empty table gives no rows. Work per text is
    linear in its length. Benchmark rows whose id is null are left out unless ``unnamed``: then their words are hit
    too, and all of them together are one null item, the last of items.
    """
    keys = [id_col, *carry]
    id_column(docs, id_col)
    blocks = item_blocks(benchmark, item_col, item_text_col, block_bytes, unnamed)
    out = docs.select(*keys, F.col(text_col).alias("__body"))
    for i, items in enumerate(blocks):
        out = _scan(out, items, window, len(keys), first=i == 0, last=i == len(blocks) - 1)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents, with all their columns, that are not contaminated."""
    whole = docs.withColumn("__row", F.struct(*all_columns(docs)))
    return decontaminate(whole, benchmark, id_col, text_col, carry=("__row",), **options).filter(~is_contaminated()).select("__row.*")


def _scan(docs: DataFrame, items: tuple[tuple[str | None, str], ...], window: int, n_keys: int, first: bool, last: bool) -> DataFrame:
    """One automaton over all texts; what earlier blocks have found is carried along."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton(items, window)
        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                yield _scan_batch(batch.slice(k, 2000), found, n_keys, first, last)

    found_here = T.StructType.fromDDL(SCHEMA if last else SEEN)
    return docs.mapInArrow(scan, T.StructType([*docs.schema.fields[:n_keys], *found_here.fields]))


def _scan_batch(batch: pa.RecordBatch, found, n_keys: int, first: bool, last: bool) -> pa.RecordBatch:
    n_words, n_hit, items, spans, ranges = [], [], [], [], []
    keys, names = batch.columns[:n_keys], batch.schema.names[:n_keys]
    texts = batch.column("__body").cast(pa.large_binary())
    old = zip(*(batch.column(c).to_pylist() for c in ("items", "ranges")), strict=True) if not first else iter([([], [])] * batch.num_rows)
    for text, (own, at) in zip(texts, old, strict=True):
        raw = text.as_py() or b""
        words = normal_words(raw)
        own, at = set(own), [*map(tuple, at)]
        if words and len(found):
            line = f" {b' '.join(words).decode('latin-1')} "
            hits = [(end, value) for end, value in found.iter(line)]
            if hits:
                gaps = np.flatnonzero(np.frombuffer(line.encode("latin-1"), np.uint8) == 32)
                lasts = np.searchsorted(gaps, [end for end, _ in hits])
                for b, (_, (n, owners)) in zip(lasts.tolist(), hits, strict=True):
                    at.append((b - n, b))
                    own.update(owners)
        merged = _merged(at)
        n_words.append(len(words))
        n_hit.append(sum(b - a for a, b in merged))
        items.append(sorted(own, key=_named_first))
        ranges.append(merged)
        spans.append(_spans(raw, merged) if merged and last else [])
    if not last:
        return pa.RecordBatch.from_arrays([*keys, batch.column("__body"), pa.array(items, pa.list_(pa.string())), pa.array(ranges, pa.list_(pa.list_(pa.int32())))],
                                          [*names, "__body", "items", "ranges"])
    pair = pa.struct([("start", pa.int32()), ("end", pa.int32())])
    return pa.RecordBatch.from_arrays(
        [*keys, pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(spans, pa.list_(pair))],
        [*names, "n_words", "n_hit", "items", "spans"])


def is_contaminated():
    """At least one word in twenty is hit."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
