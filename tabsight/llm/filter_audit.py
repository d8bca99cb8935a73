"""Audit of how document filters interact, by an incremental stream with retractions.

All files are processed as available-now micro-batches. A document's mask holds the filters that its own text
fails; whether it also repeats a text of a smaller id depends on what else arrives. So the smallest id of every text
is kept as keyed state, with the counters its documents went to. When a smaller id arrives, the earlier ones are
retracted from the counter of their mask and added to that of the mask with the duplicate filter. The counters, per
part, mask and label, are the stream's output; every order of the filters is read off them.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import pickle
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tabsight.sources.files import shared_folder

FILTERS = "ABCDE"
REPEATED = 1 << FILTERS.index("E")
BATCHES = 4
TEXTS_PER_KEY = 200

# fixed values: the filters' limits and characters
MIN_WORDS, DISTINCT_SHARE, UPPER_SHARE = 100, 80, 10
_UPPER, _SYMBOLS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*|"
_FOLLOWING = bytes(range(0x80, 0xC0))  # bytes of a character behind its first

_COMBINED = "digest binary, mask int, part string, good int, toxic int, low long, at_low long, rest long"
_NAMES = [x.split()[0] for x in _COMBINED.split(", ")]
_DELTA = "part string, mask int, good int, toxic int, delta long"


def own_mask(text: bytes) -> int:
    """Bits of the filters A to D that a text fails."""
    words = text.split()
    upper = len(text) - len(text.translate(None, _UPPER))
    points = len(text.translate(None, _FOLLOWING))
    fails = (len(words) < MIN_WORDS, 100 * len(set(words)) < DISTINCT_SHARE * len(words), 100 * upper > UPPER_SHARE * points,
             len(text.translate(None, _SYMBOLS)) < len(text))
    return sum(fail << k for k, fail in enumerate(fails))


def _measured(docs: DataFrame) -> DataFrame:
    """(doc, part, digest, mask): the text itself goes no further than its task."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("body").cast(pa.binary())
            masks, digests = [], []
            for text in texts:
                raw = text.as_py()
                masks.append(own_mask(raw))
                digests.append(hashlib.sha256(raw).digest())
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("part"), pa.array(digests, pa.binary()), pa.array(masks, pa.int32())],
                                             ["doc", "part", "digest", "mask"])

    return docs.mapInArrow(measure, "doc long, part string, digest binary, mask int")


def _combined(rows: DataFrame) -> DataFrame:
    """Rows of a batch with one text, part and labels as one: the smallest id, its rows, and how many others."""

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups: dict[tuple, list[int]] = {}
            columns = [batch.column(c).to_pylist() for c in ("digest", "mask", "part", "good", "toxic", "doc")]
            for *key, doc in zip(*columns, strict=True):
                doc = math.inf if doc is None else doc  # in a group of their own: nothing is smaller than an unknown id
                group = groups.setdefault((*key, doc == math.inf), [doc, 0, 0])
                if doc < group[0]:
                    group[:] = [doc, 0, group[1] + group[2]]
                group[1 if doc == group[0] else 2] += 1
            rows = [(*key[:5], None if low == math.inf else low, at, rest) for key, (low, at, rest) in groups.items()]
            types = (pa.binary(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], _NAMES)

    return rows.mapInArrow(combine, _COMBINED)


def _deltas(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Changes of the counters by a bucket's new rows.

    The state has, for every text of the bucket, its smallest id and the counters of that id's rows.
    """
    texts: dict[bytes, tuple] = pickle.loads(state.get[0]) if state.exists else {}
    change: dict[tuple, int] = defaultdict(int)
    for frame in frames:
        for digest, mask, part, good, toxic, new, at, rest in zip(*(frame[c].tolist() for c in _NAMES), strict=True):
            this = (part, good, toxic)
            if new is None or math.isnan(new):
                change[mask, this] += at
                continue
            new = int(new)
            low, held = texts.get(digest, (None, {}))
            if rest:
                change[mask | REPEATED, this] += rest
            if low is None or new < low:
                for other, n in held.items():  # retracted: a smaller id has arrived
                    change[mask, other] -= n
                    change[mask | REPEATED, other] += n
                low, held = new, {}
                texts[digest] = low, held
            change[mask | REPEATED * (new > low), this] += at
            if new == low:
                held[this] = held.get(this, 0) + at
    state.update((pickle.dumps(texts, pickle.HIGHEST_PROTOCOL),))
    rows = [(part, mask, good, toxic, n) for (mask, (part, good, toxic)), n in change.items() if n]
    yield pd.DataFrame(rows, columns=["part", "mask", "good", "toxic", "delta"])


def _files_per_batch(table: DataFrame, batches: int) -> int:
    return max(1, -(-len(table.inputFiles()) // batches))


def mask_counts(spark: SparkSession, path: str, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang",
                batches: int = BATCHES, texts_per_key: int = TEXTS_PER_KEY) -> DataFrame:
    """(part, mask, good, toxic, n): documents of the Parquet table at ``path`` by the filters that they fail.

    Bit k of the mask is filter k of ABCDE. Null texts are empty, a null part is an empty string. A document without an
    id repeats none and is repeated by none; rows with the same id do not repeat each other. A document is good or
    toxic if any of its labels says so. The stream's checkpoint and its changes are in the shared folder: a batch that
    is run again replaces what it wrote. ``batches`` is about how many micro-batches the files are dealt to, and
    ``texts_per_key`` about how many texts share one entry of the state, by hash, whatever the table's size.
    """
    folder = shared_folder(spark)
    table = spark.read.parquet(path)
    known = (labels.groupBy(F.col("doc_id").cast("long").alias("labelled"))
             .agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")))
    head, _, name = path.rstrip("/").rpartition("/")
    source = (spark.readStream.schema(table.schema).option("maxFilesPerTrigger", _files_per_batch(table, batches))
              .parquet(f"{head}/[{name[0]}]{name[1:]}"))  # as a pattern it may be a folder or a single file
    docs = source.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(part_col), F.lit("")).alias("part"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    joined = _measured(docs).join(known, F.col("doc") == F.col("labelled"), "left").select(
        "doc", "part", "digest", "mask", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    buckets = max(1, table.count() // texts_per_key)  # the count is in the files' footers
    bucket = F.pmod(F.xxhash64("digest"), F.lit(buckets))
    changes = _combined(joined).withColumn("bucket", bucket).groupBy("bucket").applyInPandasWithState(_deltas, _DELTA, "texts binary", "append", GroupStateTimeout.NoTimeout)

    def keep(batch: DataFrame, number: int) -> None:
        batch.groupBy("part", "mask", "good", "toxic").agg(F.sum("delta").alias("delta")).coalesce(1).write.mode("overwrite").parquet(f"{folder}/changes/batch={number}")

    query = (changes.writeStream.foreachBatch(keep).outputMode("append").option("checkpointLocation", f"{folder}/checkpoint")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    if not query.lastProgress:  # no file, no batch
        return spark.createDataFrame([], "part string, mask int, good int, toxic int, n long")
    written = spark.read.schema(_DELTA).parquet(f"{folder}/changes")
    return written.groupBy("part", "mask", "good", "toxic").agg(F.sum("delta").alias("n")).filter("n <> 0")


def orders() -> list[tuple[str, int, int, int]]:
    """(order, step, bits of the filters before it, bit of its filter) for all orders of the filters."""
    out = []
    for order in itertools.permutations(FILTERS):
        before = 0
        for step, f in enumerate(order, 1):
            out.append(("".join(order), step, before, 1 << FILTERS.index(f)))
            before |= 1 << FILTERS.index(f)
    return out


def audit(counts: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) from mask counts.

    A filter is the first to meet a document that fails m filters in one of m orders, which gives its removals over
    all orders. No counts, no rows.
    """
    steps = F.explode(F.array(*[F.struct(F.lit(o).alias("filter_order"), F.lit(s).alias("step"), F.lit(b).alias("before"), F.lit(f).alias("bit"))
                                for o, s, b, f in orders()]))
    rows = counts.withColumn("steps", steps).select("part", "mask", "good", "toxic", "n", "steps.*")
    fails = F.col("mask").bitwiseAND(F.col("bit")) != 0
    reached = F.col("mask").bitwiseAND(F.col("before")) == 0
    share = F.lit(math.factorial(len(FILTERS))) / F.bit_count("mask")
    total = lambda c, n=F.col("n"): F.coalesce(F.sum(F.when(c, n)), F.lit(0)).cast("long")
    return rows.groupBy("part", "filter_order", "step").agg(
        total(reached & ~fails).alias("kept"), total(reached & fails).alias("removed"), total(~reached & fails).alias("redundant"),
        total(F.col("mask") == F.col("bit")).alias("unique_fails"), total(reached & fails & (F.col("good") == 1)).alias("good_lost"),
        total(reached & fails & (F.col("toxic") == 1)).alias("toxic_lost"), total(fails, (F.col("n") * share).cast("long")).alias("shapley"))


#: The audit of `documents` and `labels` in DuckDB SQL.
ORACLE = """
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS body, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents),
own AS (SELECT doc_id AS labelled, max(CAST(quality = 1 AS INTEGER)) AS good, max(CAST(toxic = 1 AS INTEGER)) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
             CAST(len(w) < 100 AS INTEGER) + 2 * CAST(100 * len(list_distinct(w)) < 80 * len(w) AS INTEGER)
             + 4 * CAST(100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > 10 * length(body) AS INTEGER)
             + 8 * CAST(regexp_matches(body, '[#$%&*|]') AS INTEGER)
             + 16 * coalesce(CAST(doc_id > min(doc_id) OVER (PARTITION BY body) AS INTEGER), 0) AS mask
      FROM d LEFT JOIN own ON doc_id = labelled),
c AS (SELECT part, mask, good, toxic, count(*) AS n FROM m GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS b),
grown AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits
          FROM letters a JOIN letters b ON a.x <> b.x JOIN letters c ON c.x NOT IN (a.x, b.x) JOIN letters d ON d.x NOT IN (a.x, b.x, c.x)
          JOIN letters e ON e.x NOT IN (a.x, b.x, c.x, d.x)),
steps AS (SELECT filter_order, CAST(k AS INTEGER) AS step, bits[k] AS bit, coalesce(list_sum(bits[1 : k - 1]), 0) AS before
          FROM (SELECT *, unnest([1, 2, 3, 4, 5]) AS k FROM grown)),
r AS (SELECT *, mask & bit <> 0 AS fails, mask & CAST(before AS INTEGER) = 0 AS reached FROM c, steps)
SELECT part, filter_order, step, CAST(coalesce(sum(n) FILTER (reached AND NOT fails), 0) AS BIGINT) AS kept,
       CAST(coalesce(sum(n) FILTER (reached AND fails), 0) AS BIGINT) AS removed, CAST(coalesce(sum(n) FILTER (NOT reached AND fails), 0) AS BIGINT) AS redundant,
       CAST(coalesce(sum(n) FILTER (mask = bit), 0) AS BIGINT) AS unique_fails, CAST(coalesce(sum(n) FILTER (reached AND fails AND good = 1), 0) AS BIGINT) AS good_lost,
       CAST(coalesce(sum(n) FILTER (reached AND fails AND toxic = 1), 0) AS BIGINT) AS toxic_lost,
       CAST(coalesce(sum(n * 120 // greatest(bit_count(mask), 1)) FILTER (fails), 0) AS BIGINT) AS shapley
FROM r GROUP BY part, filter_order, step
"""
