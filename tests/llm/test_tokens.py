import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tabsight.llm import packing, token_files
from tabsight.llm.encoder import ChunkEncoder
from tabsight.llm.queries import byte_bpe
from tests.llm.edge import SCHEMA, awkward

ROWS = awkward()


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(byte_bpe())


def ids_of(library, text, end):
    return [*library.encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_chunks_give_the_ids_of_whole_texts(library, monkeypatch):
    texts = [r[1] for r in ROWS] + ["a  b", "　 x", "x   y", "é à", "tab\t\tend ", "<|endoftext|> a", "I'll 'll", "😀 😀",
                                    "a,b. é, é; ×, ÷. don't, 'tis. ü'll.'s !!, …, …b, ½, x).' y\"? 中, ß] Ã, \xa0, é\u0301, a\x00, <|endoftext|>, b,<|endoftext|>"]
    own = ChunkEncoder(byte_bpe())
    assert {i: x.tolist() for i, x in own.encode(pa.array(texts))} == {i: ids_of(library, t, 0)[:-1] for i, t in enumerate(texts)}
    monkeypatch.setattr("tabsight.llm.encoder.CACHE_CHUNKS", 3)
    monkeypatch.setattr("tabsight.llm.encoder.MAX_SLICE", 100)
    assert {i: x.tolist() for i, x in own.encode(pa.array(texts))} == {i: ids_of(library, t, 0)[:-1] for i, t in enumerate(texts)}


def test_ranks_round_trip():
    rnd = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 5, 1000):
        ranks = (rnd.integers(0, 2**32, n) >> rnd.integers(0, 32, n)).astype(np.uint32)
        for counts in ([n], [0, n // 2, 0, n - n // 2], [0] * 3 + [n]):
            control, data = token_files.encode_many(ranks, np.array(counts))
            assert (token_files.decode_many(b"".join(control), b"".join(data), np.array(counts)) == ranks).all()
            alone = [token_files.encode_many(r, np.array([len(r)])) for r in np.split(ranks, np.cumsum(counts)[:-1])]
            assert [c for c, _ in alone] == [[c] for c in control] and [d for _, d in alone] == [[d] for d in data]


def test_token_files_round_trip(spark, library, tmp_path):
    docs = spark.createDataFrame(ROWS, SCHEMA).repartition(5)
    token_files.write_token_files(docs, str(tmp_path / "t"), byte_bpe(), 2)
    got = token_files.read_token_files(spark, str(tmp_path / "t")).orderBy("start").collect()
    want = sorted(((r[0], ids_of(library, r[1], 2)) for r in ROWS), key=lambda x: (x[0] is not None, x[0] or 0))
    at = 0
    for g, (doc, ids) in zip(got, want, strict=True):
        assert (g["doc_id"], g["start"], g["n_tokens"], g["ids_crc32"]) == (doc, at, len(ids), crc(ids))
        assert np.frombuffer(g["ids"], "<u4").tolist() == ids
        at += len(ids)
    ranks = {r["rank"]: r["token"] for r in spark.read.parquet(str(tmp_path / "t/ranks")).collect()}
    seen = np.bincount(np.concatenate([i for _, i in want]))
    assert [int(seen[ranks[k]]) for k in range(len(ranks))] == sorted(seen[seen > 0].tolist(), reverse=True)


def test_token_files_of_an_empty_table(spark, tmp_path):
    token_files.write_token_files(spark.createDataFrame([], SCHEMA), str(tmp_path / "t"), byte_bpe(), 2)
    assert token_files.read_token_files(spark, str(tmp_path / "t")).count() == 0


def check_plan(counts, capacity):
    fill, large = defaultdict(list), defaultdict(int)
    done = defaultdict(list)
    for length, low, high, each, sequence, offset in packing.packing_plan(counts, capacity):
        done[length] += range(low, high)
        for r in range(high - low):
            fill[sequence + r // each].append((offset + r % each * length, length))
            large[sequence + r // each] += 3 * length > capacity
    assert {k: sorted(v) for k, v in done.items()} == {k: list(range(n)) for k, n in counts.items() if n}
    for spots in fill.values():
        at = 0
        for offset, length in sorted(spots):
            assert offset == at
            at += length
        assert at <= capacity
    assert max(large.values(), default=0) <= 2
    return len(fill)


def test_plan_fills_without_gaps_and_tightly():
    rnd = np.random.default_rng(2)
    for capacity, top, n in ((10, 10, 50), (100, 100, 400), (100, 20, 300), (2048, 2048, 3000)):
        lengths, counts = np.unique(rnd.integers(1, top + 1, n), return_counts=True)
        counts = dict(zip(lengths.tolist(), counts.tolist(), strict=True))
        used = check_plan(counts, capacity)
        assert used <= 1.1 * sum(k * v for k, v in counts.items()) / capacity + 1 + sum(v for k, v in counts.items() if 2 * k > capacity) * 0.2
    assert check_plan({7: 1000, 3: 1000}, 10) == 1000
    assert check_plan({4: 5}, 10) == 3
    assert check_plan({}, 10) == 0


@pytest.mark.parametrize("capacity", [16, 2048])
def test_packing(spark, library, capacity):
    docs = spark.createDataFrame(ROWS, SCHEMA).repartition(4)
    got = packing.pack(docs, byte_bpe(), 0, capacity).collect()
    pieces = defaultdict(list)
    for r in ROWS:
        ids = ids_of(library, r[1], 0)
        first = len(ids) % capacity
        cuts = [0, *([first] if first else []), *range(first + capacity, len(ids) + 1, capacity)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            pieces[(r[0], k, a, b - a, crc(ids[a:b]))].append(1)
    have = defaultdict(list)
    places = defaultdict(list)
    for g in got:
        have[(g["doc_id"], g["piece"], g["start"], g["length"], g["ids_crc32"])].append(1)
        places[g["sequence_id"]].append((g["offset"], g["length"]))
    assert have == pieces
    for spots in places.values():
        at = 0
        for offset, length in sorted(spots):
            assert offset == at
            at += length
        assert at <= capacity


def test_sequences_hold_the_ids(spark, library):
    rows = [r for r in ROWS if r[0] is not None and r[0] < 40]
    docs = spark.createDataFrame(rows, SCHEMA)
    placed = packing.pack(docs, byte_bpe(), 0, 64)
    out = {r["sequence_id"]: r["ids"] for r in packing.sequences(docs, placed, byte_bpe(), 0).collect()}
    for g in placed.collect():
        assert crc(out[g["sequence_id"]][g["offset"]: g["offset"] + g["length"]]) == g["ids_crc32"]


def test_packing_of_an_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], SCHEMA), byte_bpe()).count() == 0
