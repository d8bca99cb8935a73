import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from tabsight.llm import runs
from tabsight.llm.exact_repeats import remove_repeated_bytes
from tabsight.llm.prefix_free import repeated_in_order, stretches
from tabsight.llm.runs import Kind, byte_elements, minimiser_runs, word_elements
from tabsight.llm.substring_dedup import remove_repeats, trimmed
from tests.llm.edge import SCHEMA, awkward


def fixture():
    rnd = random.Random(9)
    words = ["a", "bb", "über", "ccc", "中", "d.", "ee", "f", "gg", "hh"] + ["w%d" % i for i in range(200)]
    passages = [" ".join(rnd.choice(words) for _ in range(rnd.randint(3, 40))) for _ in range(12)]
    docs = []
    for i in range(90):
        parts = [rnd.choice(passages) if rnd.random() < 0.5 else " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 25))) for _ in range(rnd.randint(1, 6))]
        docs.append((i, rnd.choice([" ", "\n", "  "]).join(parts), "n", "p"))
    docs += [(200 + i, docs[5][1], "n", "p") for i in range(30)]  # exact copies
    docs += [(300 + i, passages[0] + " " + rnd.choice(words) + " " + " ".join(rnd.choice(words) for _ in range(9)), "n", "p") for i in range(40)]
    docs += [(400, "x " * 500, "n", "p"), (401, "x " * 90, "n", "p"), (402, "ab" * 300, "n", "p"), (403, "spam ham " * 60, "n", "p")]
    awk = awkward(10)
    return docs + [(r[0] + 1000 if r[0] is not None else None, *r[1:]) for r in awk]


def brute_words(rows, window):
    inf = 2**63
    first = {}
    split = [(inf if r[0] is None else r[0], (r[1] or "").encode().split()) for r in rows]
    for doc, w in split:
        for k in range(len(w) - window + 1):
            g = tuple(w[k: k + window])
            first[g] = min(first.get(g, inf), doc)
    out = []
    for doc, w in split:
        gone = {j for k in range(len(w) - window + 1) if first[tuple(w[k: k + window])] < doc for j in range(k, k + window)}
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((doc, len(w), len(gone), kept.decode(), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def brute_bytes(rows, length):
    count = defaultdict(int)
    texts = [(2**63 if r[0] is None else r[0], (r[1] or "").encode()) for r in rows]
    for _, t in texts:
        for k in range(len(t) - length + 1):
            count[t[k: k + length]] += 1
    out = []
    for doc, t in texts:
        gone = np.zeros(len(t) + 2, bool)
        for k in range(len(t) - length + 1):
            if count[t[k: k + length]] > 1:
                gone[k + 1: k + length + 1] = True
        kept = np.frombuffer(t, np.uint8)[~gone[1:-1]].tobytes()
        out.append((doc, len(t), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum()), kept, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def rows_of(df):
    return sorted((2**63 if r[0] is None else r[0], *(bytes(x) if isinstance(x, bytearray) else x for x in tuple(r)[1:])) for r in df.collect())


@pytest.mark.parametrize("window,gram,wide", [(13, 5, 20_000), (13, 5, 3), (4, 2, 20_000), (5, 5, 20_000)])
def test_words_against_brute_force(spark, window, gram, wide):
    rows = fixture()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(6)
    assert rows_of(remove_repeats(docs, window=window, gram=gram, wide=wide)) == brute_words(rows, window)


@pytest.mark.parametrize("length,gram,every,wide", [(50, 16, 64, 20_000), (50, 16, 8, 3), (61, 9, 4, 20_000), (50, 16, 1, 20_000)])
def test_bytes_against_brute_force(spark, length, gram, every, wide):
    rows = [r for r in fixture() if len(r[1] or "") < 5000]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(6)
    assert rows_of(remove_repeated_bytes(docs, length=length, gram=gram, every=every, wide=wide)) == brute_bytes(rows, length)


@pytest.mark.parametrize("every,wide", [(64, 5_000), (16, 5_000), (16, 4)])
def test_bytes_of_periodic_and_templated_texts(spark, every, wide):
    rnd = random.Random(every)
    noise = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    head = noise(700)
    texts = ["z" * 3000, "z" * 401, "y" * 400, "abc" * 500, noise(37) * 60, noise(900), head, head[:400], head[1:399]]
    texts += [noise(rnd.randint(0, 30)) + head + noise(rnd.randint(0, 500)) for _ in range(40)]
    texts += [noise(50) + head[k: k + 397 + k % 7] + noise(50) for k in range(0, 280, 7)]
    rows = [(k, t, "n", "p") for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert rows_of(remove_repeated_bytes(docs, every=every, wide=wide)) == brute_bytes(rows, 400)


def test_order_of_phrases_and_parse_equals_equal_windows():
    rnd = random.Random(4)
    kind, every = Kind("byte", 24, 8), 3
    for _ in range(30):
        data = np.frombuffer("".join(rnd.choice("ab") for _ in range(60)).encode() * 2 + bytes(rnd.choice(b"abc") for _ in range(80)), np.uint8)
        e = byte_elements(data, np.array([0, 70, 120, len(data)]))
        first, n, _, anchored = stretches(e, np.zeros(0, np.int64), kind.length, kind.width, every)
        windows = np.sort(np.concatenate([np.arange(a, a + k) for a, k in zip(first, n, strict=True)]))
        assert windows.tolist() == [i for a, z in zip(e.offsets, e.offsets[1:]) for i in range(a, z - kind.length + 1)]
        first, n = first[anchored], n[anchored]
        raw = data.tobytes()
        packed = [raw[a: a + k + kind.length - 1] for a, k in zip(first, n, strict=True)]
        own = byte_elements(np.frombuffer(b"".join(packed), np.uint8), np.cumsum([0, *map(len, packed)]))
        content = [(r, j, packed[r][j: j + kind.length]) for r in range(len(packed)) for j in range(n[r])]
        count = defaultdict(int)
        for _, _, c in content:
            count[c] += 1
        rows, at = repeated_in_order(own, n, kind, every)
        assert list(zip(rows.tolist(), at.tolist())) == [(r, j) for r, j, c in content if count[c] > 1]


def test_a_range_of_many_stretches_is_one_task_or_spread(spark):
    rnd = random.Random(1)
    head = "".join(rnd.choice("abcdefgh") for _ in range(500))
    texts = [head + "%08x" % rnd.getrandbits(32) + head[:20] for _ in range(20_000)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = remove_repeated_bytes(docs).groupBy("n_spans").agg({"n_removed": "min"}).collect()
    assert len(got) == 1 and got[0][0] == 1 and got[0][1] >= 500


def test_long_texts_are_cut_into_steps_and_chunks(spark, monkeypatch):
    whole = [" ".join("v%d" % random.Random(i // 700).randint(0, 10**6) for i in range(9000))] * 2
    data = np.frombuffer("".join(whole).encode(), np.uint8)
    e = word_elements(data, np.array([0, len(data) // 2, len(data)]))
    monkeypatch.setattr(runs, "STEP", 1000)
    first, n, _ = minimiser_runs(e, Kind("word", 13, 5))
    starts = np.concatenate([np.arange(a, a + k) for a, k in zip(first, n, strict=True)])
    assert starts.tolist() == [*range(9000 - 12), *range(9000, 18000 - 12)]
    monkeypatch.setattr(runs, "CHUNK_BYTES", 2000)
    rows = fixture()
    assert rows_of(remove_repeats(spark.createDataFrame(rows, SCHEMA))) == brute_words(rows, 13)


def test_equal_hashes_of_different_windows(spark, monkeypatch):
    monkeypatch.setattr(runs.Elements, "windows", lambda self, at, length, seed=17: np.zeros(len(at), np.uint64))
    e = word_elements(np.frombuffer(b"a b c a b d a b c", np.uint8), np.array([0, 17]))
    order, new = runs._classes(e, np.arange(8), Kind("word", 2, 1))
    group = np.empty(8, int)
    group[order] = np.cumsum(new)
    pairs = ["ab", "bc", "ca", "ab", "bd", "da", "ab", "bc"]
    assert all((group[i] == group[j]) == (pairs[i] == pairs[j]) for i in range(8) for j in range(8))


def test_trimmed_keeps_columns_and_clean_texts(spark):
    rows = fixture()
    got = sorted(trimmed(spark.createDataFrame(rows, SCHEMA)).collect(), key=lambda r: (r[0] is None, r[0] or 0))
    for g, w, r in zip(got, sorted(brute_words(rows, 13), key=lambda x: x[0]), sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)), strict=True):
        assert g["text"] == (w[3] if w[2] else r[1]) and (g["n"], g["part"]) == (r[2], r[3])


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert remove_repeats(none).count() == remove_repeated_bytes(none).count() == trimmed(none).count() == 0
