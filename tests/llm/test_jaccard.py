import random
from collections import Counter

import pytest

from tabsight.llm import jaccard_join
from tabsight.llm.graph import components
from tabsight.llm.jaccard_join import near_duplicates
from tests.llm.edge import SCHEMA, awkward


def fixture():
    rnd = random.Random(4)
    vocabulary = ["w%d" % i for i in range(3000)]
    docs = []
    for i in range(60):
        base = [rnd.choice(vocabulary) for _ in range(rnd.randint(5, 200))]
        docs.append(" ".join(base))
        for _ in range(rnd.choice([0, 0, 1, 2, 4])):
            other = base[:]
            for _ in range(rnd.randint(0, max(1, len(base) // 40))):
                other[rnd.randrange(len(other))] = rnd.choice(vocabulary)
            docs.append(rnd.choice([" ", "\n"]).join(other))
    hot = [rnd.choice(vocabulary) for _ in range(150)]
    for _ in range(330):  # a large group of near copies, and a passage many documents share
        other = hot[:]
        for _ in range(rnd.randint(0, 5)):
            other[rnd.randrange(150)] = rnd.choice(vocabulary)
        docs.append(" ".join(other))
    docs += [" ".join(hot[:60] + [rnd.choice(vocabulary) for _ in range(60)]) for _ in range(60)]
    docs += [docs[0]] * 40 + ["one two three", "one two three", "four"]
    rows = [(10_000 + i, t, "n", "p") for i, t in enumerate(docs)]
    rnd.shuffle(rows)
    return rows + awkward(12)


def shingles(text):
    w = (text or "").encode().split()
    return frozenset(tuple(w[k: k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    sets = [shingles(r[1]) for r in rows]
    distinct = [s for s in dict.fromkeys(sets) if s]
    parent = list(range(len(distinct)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = Counter()
    for i, a in enumerate(distinct):
        for j in range(i):
            b = distinct[j]
            if 5 * len(a & b) >= 4 * len(a | b):
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    number = {s: i for i, s in enumerate(distinct)}
    copies = Counter(sets)
    least = {}
    for r, s in zip(rows, sets, strict=True):
        if s and r[0] is not None:
            k = root(number[s])
            least[k] = min(least.get(k, r[0]), r[0])
    return Counter((r[0], least.get(root(number[s])) if s else r[0], copies[s] if s else 1, links[number[s]] if s else 0) for r, s in zip(rows, sets, strict=True))


@pytest.mark.parametrize("block", [128, 7])
def test_against_brute_force(spark, block):
    rows = fixture()
    got = Counter(tuple(r) for r in near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(6), block=block).collect())
    want = brute(rows)
    assert got == want
    assert max(r[3] for r in want) > 150


def test_depth_shrinks_only_as_far_as_needed(spark, monkeypatch):
    rows = fixture()
    asked = []
    real = jaccard_join.candidates
    monkeypatch.setattr(jaccard_join, "candidates", lambda c, depth, near, permille: asked.append(depth) or real(c, depth, near, permille))
    near_duplicates(spark.createDataFrame(rows, SCHEMA), recall=0.5).count()
    assert asked == [8]
    near_duplicates(spark.createDataFrame(rows, SCHEMA), recall=0.99999).count()
    assert asked[1] == 8 and asked[-1] < 8 and jaccard_join.found_share(0.8, asked[-1]) >= 0.99


def test_components(spark):
    rnd = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(200, 260)] + [(rnd.randint(1000, 1100), rnd.randint(1000, 1100)) for _ in range(60)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    looped = {x for e in edges if e[0] != e[1] for x in e}
    assert got == {x: root(x) for x in looped}


def test_empty_tables(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    assert near_duplicates(spark.createDataFrame([(1, "a", None, None)], SCHEMA)).collect()[0]["class_id"] == 1


def test_one_of_each_class_stays(spark):
    rows = fixture() + [(3, "one two three", "n", "p"), (3, "one two three", "n", "p"), (None, "seven lone words in a row here", None, None),
                        (None, "seven lone words in a row here", None, None), (None, "one two three", None, None), (77, "", None, None), (77, "", None, None)]
    got = Counter((r["doc_id"], r["text"]) for r in jaccard_join.one_of_each(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect())
    per_text = brute_classes(rows)
    blank = Counter((r[0], r[1]) for r in rows if per_text[r[1]] is None)
    groups = {per_text[r[1]] for r in rows} - {None}
    assert sum(got.values()) == sum(blank.values()) + len(groups)
    assert all(got[x] == n for x, n in blank.items())
    kept = {}
    for (doc, text), n in got.items():
        if per_text[text] is not None:
            assert n == 1 and per_text[text] not in kept
            kept[per_text[text]] = doc
    for r in rows:
        key = per_text[r[1]]
        if key is not None and r[0] is not None:
            assert kept[key] is not None and kept[key] <= r[0]


def brute_classes(rows):
    """Text to a name of its class, None for texts without words."""
    texts = list({r[1] for r in rows})
    sets = [shingles(t) for t in texts]
    name = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 5 * len(a & b) >= 4 * len(a | b) and name[i] != name[j]:
                old, new = name[i], name[j]
                name = [new if x == old else x for x in name]
    return {t: name[i] if sets[i] else None for i, t in enumerate(texts)}
