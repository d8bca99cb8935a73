"""N-gram Jaccard join by a MinHash LSH forest with exact verification.

Documents with equal sets of word shingles form a class and are compared once. Every class has a label of
``DEPTH`` minimum hashes in each of ``TREES`` trees. A tree's labels, sorted, are its prefix trie: classes that
share a prefix stand together, those with the longest common prefix side by side. Each class meets its next
``NEAR`` neighbours, of those with its own full label only the next ``CLOSE``; classes further apart in a long stretch are met through the chain between them. The matched
prefix starts at full depth and is shortened until the expected recall, from the similarities found, is enough;
the depth that reaches it at the threshold itself ends the search.

Pairs whose sketches rule the threshold out are dropped. What remains connects classes to groups, and within a
group all pairs are verified exactly, block against block, so no list of pairs is ever made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabsight.llm.graph import components
from tabsight.llm.runs import SLICE_BYTES, keyed, mix, odd, word_elements
from tabsight.llm.text import all_columns, id_column, own_name, slices, string_buffers
from tabsight.sources.files import materialised

SHINGLE = 5
PERMILLE = 800
TREES = 32
DEPTH = 8
RECALL = 0.9999
NEAR = 8
#: Of the next neighbours with the same full label, so many are met: the group is verified as a whole later.
CLOSE = 2
BLOCK = 128
SKETCH = 128
#: Standard deviations that a sketch may be below the threshold.
SLACK = 6.0


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, and the n + 1 offsets.

    A text of fewer words than a shingle, but not none, has one shingle of all its words.
    """
    e = word_elements(data, offsets)
    n = np.diff(e.offsets)
    grams = e.grams(width) if len(e.hashes) else np.zeros(0, np.uint64)
    sets = []
    for i in range(len(n)):
        if n[i] >= width:
            sets.append(np.unique(grams[e.offsets[i]: e.offsets[i + 1] - width + 1]))
        elif n[i]:
            sets.append(e.windows(e.offsets[i: i + 1], int(n[i])) + np.uint64(n[i]))
        else:
            sets.append(np.zeros(0, np.uint64))
    return np.concatenate([np.zeros(0, np.uint64), *sets]), np.concatenate(([0], np.cumsum([len(s) for s in sets], dtype=np.int64)))


def minimum_hashes(values: np.ndarray, offsets: np.ndarray, number: int) -> np.ndarray:
    """(sets, number) 16-bit minimum hashes of non-empty sets."""
    out = np.empty((len(offsets) - 1, number), np.uint16)
    factors = odd(number, 29)
    for i, j in slices(offsets, 1 << 16):
        part, at = values[offsets[i]: offsets[j]], offsets[i:j] - offsets[i]
        for k in range(number):
            out[i:j, k] = mix(np.minimum.reduceat(part * factors[k], at)).astype(np.uint16)
    return out


def signatures(texts: DataFrame, width: int) -> DataFrame:
    """(id, tkey, hi, lo, labels, sketch) of texts with words; hi and lo name the set of shingles."""
    kind = texts.schema["id"].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = string_buffers(batch.column(2))
            for i, j in slices(offsets, SLICE_BYTES):
                values, at = shingle_sets(data[offsets[i]: offsets[j]], offsets[i: j + 1] - offsets[i], width)
                full = np.flatnonzero(np.diff(at))
                if not len(full):
                    continue
                at = np.append(at[full], at[-1])
                size = np.diff(at).astype(np.uint64)
                hi, lo = (mix(np.add.reduceat(mix(values ^ np.uint64(seed)), at[:-1]) + size).view(np.int64) for seed in (0x5BD1E995, 0x2545F4914F6CDD1D))
                hashes = minimum_hashes(values, at, TREES * DEPTH)
                rows = pa.array(full + i)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(hi), pa.array(lo),
                     pa.array([x.tobytes() for x in hashes], pa.binary()), pa.array([x.tobytes() for x in hashes[:, :SKETCH].astype(np.uint8)], pa.binary())],
                    ["id", "tkey", "hi", "lo", "labels", "sketch"])

    return texts.mapInArrow(sign, f"id {kind}, tkey long, hi long, lo long, labels binary, sketch binary")


def found_share(similarity: float, depth: int, trees: int = TREES) -> float:
    """Share of pairs of a similarity that agree in a prefix of that depth in at least one tree."""
    return 1 - (1 - similarity**depth) ** trees


def candidates(classes: DataFrame, depth: int, near: int, permille: int) -> DataFrame:
    """(a, b, similarity) of pairs of classes (node, labels, sketch) whose sketches allow the threshold."""
    tree = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.substring("labels", t * 2 * DEPTH + 1, F.lit(2 * DEPTH)))).alias("tree", "label")
    trie = Window.partitionBy("tree", "prefix").orderBy("label", "node").rowsBetween(1, near)
    pairs = (classes.select("node", tree).withColumn("prefix", F.substring("label", 1, 2 * depth))
             .withColumn("others", F.collect_list(F.struct("label", "node")).over(trie)).filter(F.size("others") > 0)
             .withColumn("others", F.filter("others", lambda o, i: (i < CLOSE) | (o["label"] != F.col("label"))))
             .select("node", F.explode("others.node").alias("other"))
             .select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct())
    left = classes.select(F.col("node").alias("a"), F.col("sketch").alias("x"))
    right = classes.select(F.col("node").alias("b"), F.col("sketch").alias("y"))
    least = permille / 1000 - SLACK * (permille / 1000 * (1 - permille / 1000) / SKETCH) ** 0.5

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, SKETCH) for c in ("x", "y"))
            similarity = ((x == y).mean(1) - 1 / 256) / (1 - 1 / 256)
            keep = np.flatnonzero(similarity >= least)
            rows = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column("a").take(rows), batch.column("b").take(rows), pa.array(similarity[keep])], ["a", "b", "similarity"])

    return pairs.join(left, "a").join(right, "b").mapInArrow(compare, "a long, b long, similarity double")


def adaptive_candidates(classes: DataFrame, near: int, permille: int, recall: float) -> DataFrame:
    """Candidates at the largest depth whose expected recall, from the similarities it finds, is enough."""
    for depth in range(DEPTH, 0, -1):
        found = materialised(candidates(classes, depth, near, permille))
        if depth == 1 or found_share(permille / 1000, depth) >= recall:
            return found
        share = 1 - F.pow(1 - F.pow(F.greatest(F.col("similarity"), F.lit(permille / 1000)), F.lit(depth)), F.lit(TREES))
        row = found.filter(F.col("similarity") >= permille / 1000).agg(F.count(F.lit(1)).alias("n"), F.sum(1 / share).alias("all")).first()
        if row["n"] and row["n"] / row["all"] >= recall:
            return found
    raise AssertionError("unreachable")


def verified(texts: DataFrame, members: DataFrame, width: int, permille: int, block: int) -> DataFrame:
    """(node, n_links, root) for members (group, node, id, tkey), all pairs of a group compared exactly.

    A group is cut into blocks; a task holds one block and reads the group's other members past it. A row with
    n_links is a class of the block, one without joins a class of another block to its root.
    """
    size = members.groupBy("group").agg(F.count(F.lit(1)).alias("size"))
    blocks = F.ceil(F.col("size") / block).cast("int")
    right = members.join(size, "group").select("group", "node", F.col("id").alias("id2"), F.col("tkey").alias("tkey2"), blocks.alias("blocks"))
    found = texts.join(right, (F.col("tkey") == F.col("tkey2")) & F.col("id").eqNullSafe(F.col("id2"))).select("group", "node", "blocks", "body")

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = string_buffers(batch.column("body"))
            for i, j in slices(offsets, SLICE_BYTES):
                values, at = shingle_sets(data[offsets[i]: offsets[j]], offsets[i: j + 1] - offsets[i], width)
                sets = [values[a:b].tobytes() for a, b in zip(at, at[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in ("group", "node", "blocks")), pa.array(sets, pa.binary())],
                                                 ["group", "node", "blocks", "shingles"])

    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    # a document that stands in the table several times has one set
    sets = found.dropDuplicates(["node"]).mapInArrow(shingle, "group long, node long, blocks int, shingles binary")
    dealt = (sets.withColumn("own", own).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .withColumn("own", F.col("own") == F.col("block")).repartition("group", "block").sortWithinPartitions("group", "block", F.desc("own"), "node"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, task = None, None
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("group", "block", "own", "node")), batch.column("shingles"), strict=True)
            for group, number, is_own, node, shingles in rows:
                if key != (group, number):
                    if task:
                        yield task.result()
                    key, task = (group, number), _Block(permille)
                values = np.frombuffer(shingles.as_buffer(), np.uint64)
                (task.add if is_own else task.meet)(node, values)
        if task:
            yield task.result()

    return dealt.mapInArrow(compare, "node long, n_links long, root long")


class _Block:
    """Exact links of a block's classes with each other and with the classes that are read past them."""

    def __init__(self, permille: int):
        self.permille = permille
        self.nodes: list[int] = []
        self.sets: list[np.ndarray] = []
        self.index = None
        self.others: list[tuple[int, int]] = []

    def add(self, node: int, values: np.ndarray) -> None:
        self.nodes.append(node)
        self.sets.append(values)

    def _ready(self) -> None:
        owner = np.repeat(np.arange(len(self.sets)), [len(s) for s in self.sets])
        every = np.concatenate(self.sets)
        order = np.argsort(every, kind="stable")
        self.owner = owner[order]
        self.index, self.first = np.unique(every[order], return_index=True)
        self.first = np.append(self.first, len(every))
        self.size = np.array([len(s) for s in self.sets])
        self.links = np.zeros(len(self.sets), np.int64)
        self.label = np.arange(len(self.sets))
        for k, values in enumerate(self.sets):
            linked = self._linked(values)
            self.links[linked[linked != k]] += 1
            self._join(linked)

    def _linked(self, values: np.ndarray) -> np.ndarray:
        """Own classes whose similarity with the set is high enough."""
        at = np.searchsorted(self.index, values)
        inside = at < len(self.index)
        hit = at[inside][self.index[at[inside]] == values[inside]]
        low, n = self.first[hit], self.first[hit + 1] - self.first[hit]
        total = int(n.sum())
        if not total:
            return np.zeros(0, np.int64)
        steps = np.arange(total) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
        common = np.bincount(self.owner[steps], minlength=len(self.sets))
        return np.flatnonzero((common > 0) & (common * (1000 + self.permille) >= self.permille * (self.size + len(values))))

    def _join(self, linked: np.ndarray) -> None:
        if len(linked) > 1:
            labels = self.label[linked]
            least = labels.min()
            if (labels != least).any():
                self.label[np.isin(self.label, labels)] = least

    def meet(self, node: int, values: np.ndarray) -> None:
        if not self.sets:
            return
        if self.index is None:
            self._ready()
        linked = self._linked(values)
        if len(linked):
            self.links[linked] += 1
            self._join(linked)
            self.others.append((node, int(linked[0])))

    def result(self) -> pa.RecordBatch:
        if self.index is None and self.sets:
            self._ready()
        nodes = np.array(self.nodes, np.int64)
        node = [*self.nodes, *(x for x, _ in self.others)]
        links = [*(self.links.tolist() if self.sets else []), *[None] * len(self.others)]
        root = [*(nodes[self.label].tolist() if self.sets else []), *(int(nodes[self.label[k]]) for _, k in self.others)]
        return pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(links, pa.int64()), pa.array(root, pa.int64())], ["node", "n_links", "root"])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE,
                    permille: int = PERMILLE, near: int = NEAR, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """(id, class_id, n_copies, n_links) per document.

    n_copies counts the documents with the same set of shingles, this one included; n_links the other sets with a
    similarity of at least ``permille`` thousandths; class_id is the smallest id of all documents that links
    connect. Null, empty and blank texts have no shingles: each is a class of its own with its own id. A null id is
    kept, and ignored in class_id where the class has others; repeated rows are copies; an empty table gives no
    rows. Words are runs without ASCII white space. Other columns are not read.
    """
    found = _classed(keyed(id_column(docs, id_col), id_col, text_col), width, permille, near, recall, block)
    return found.select(F.col("id").alias(id_col), "class_id", "n_copies", "n_links")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents, with all their columns, of which one of each class stays: that with the smallest id.

    Of repeated rows one stays; texts without words all stay, also where they are repeated.
    """
    defaults = {"width": SHINGLE, "permille": PERMILLE, "near": NEAR, "recall": RECALL, "block": BLOCK}
    found = materialised(_classed(keyed(id_column(docs, id_col), id_col, text_col), **defaults | options))
    lone = F.struct(F.col("tkey"), F.col("blank"))
    own_id, own_key, own_blank, place = (own_name(docs, c) for c in ("__id", "__tkey", "__blank", "__number"))
    best = (found.filter(F.col("id").eqNullSafe(F.col("class_id"))).groupBy("id", "class_key").agg(F.min(lone).alias("first"))
            .select(F.col("id").alias(own_id), F.col("first.tkey").alias(own_key), F.col("first.blank").alias(own_blank)).distinct())
    key = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    kept = docs.join(best, (key == F.col(own_key)) & F.col(id_col).eqNullSafe(F.col(own_id)))
    repeated = found.filter("not blank").groupBy("id", "tkey").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count()
    if repeated:  # several rows with one id and text
        number = F.row_number().over(Window.partitionBy(own_id, own_key).orderBy(F.lit(0)))
        kept = kept.withColumn(place, number).filter((F.col(place) == 1) | F.col(own_blank))
    return kept.select(*all_columns(docs))


def _classed(texts: DataFrame, width: int, permille: int, near: int, recall: float, block: int) -> DataFrame:
    """(id, tkey, class_id, class_key, blank, n_copies, n_links); class_key tells classes apart where ids are null."""
    signed = materialised(signatures(texts, width))
    first = F.struct(F.col("id").isNull().alias("none"), "id", "tkey")
    classes = materialised(signed.groupBy("hi", "lo").agg(F.count(F.lit(1)).alias("n_copies"), F.min(first).alias("first"), F.first("labels").alias("labels"), F.first("sketch").alias("sketch"))
                           .select(F.monotonically_increasing_id().alias("node"), "hi", "lo", "n_copies", "first.id", "first.tkey", "labels", "sketch"))
    pairs = adaptive_candidates(classes.select("node", "labels", "sketch"), near, permille, recall)
    groups = materialised(components(pairs))
    members = groups.join(classes.select("node", "id", "tkey"), "node").select(F.col("root").alias("group"), "node", "id", "tkey")
    links = materialised(verified(texts, members, width, permille, block))
    joined = components(links.select(F.col("node").alias("a"), F.col("root").alias("b")))
    small = joined.join(classes.select("node", "id"), "node").groupBy("root").agg(F.min("id").alias("least"))
    linked = (joined.join(small, "root").select("node", "root", "least")
              .join(links.filter("n_links is not null").select("node", "n_links"), "node", "left"))
    named = classes.select("node", "hi", "lo", "n_copies", F.col("id").alias("own")).join(linked, "node", "left").select(
        "hi", "lo", "n_copies", F.coalesce("least", "own").alias("class_id"), F.coalesce("root", "node").alias("class_key"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    out = signed.select("id", "tkey", "hi", "lo").join(named, ["hi", "lo"]).select("id", "tkey", "class_id", "class_key", F.lit(False).alias("blank"), "n_copies", "n_links")
    blank = texts.filter(F.trim(F.translate("body", "\t\n\x0b\x0c\r", "     ")) == "").select(
        "id", "tkey", F.col("id").alias("class_id"), F.col("tkey").alias("class_key"), F.lit(True).alias("blank"), F.lit(1).cast("long").alias("n_copies"), F.lit(0).cast("long").alias("n_links"))
    return out.unionByName(blank)
