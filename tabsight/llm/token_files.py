"""Token files: frequency-ranked ids in bytes of variable number, with the control bits apart.

A token is stored as its rank by corpus frequency, in as few bytes (1 to 4) as the rank needs. Two control bits
for each token say how many; they stand in bytes of their own, so a table with a row per control byte gives the
lengths of four tokens at once and numpy gathers the data bytes without a loop over tokens.

On disk a token file is a Parquet file with a row per document (part, start in the part, id, n_tokens, control,
data), rows and files in ascending order of the ids; the ranks' ids lie beside them. Spark commits the files, so
lost executors leave no halves and any store that Spark reaches will do.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabsight.llm.encoder import encoder
from tabsight.llm.text import id_column, string_buffers
from tabsight.sources.files import discard, materialised

#: Control byte to the byte counts of its four tokens.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1


def encode_many(ranks: np.ndarray, counts: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """Control and data bytes of each document's non-negative ranks below 2**32, which stand one after the other."""
    ranks = ranks.astype("<u4")
    size = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    room = -(-counts // 4) * 4  # a document's control bytes are its own
    ends, stops = np.cumsum(counts), np.cumsum(room)
    code = np.zeros(int(stops[-1]) if len(stops) else 0, np.uint8)
    code[np.arange(len(ranks)) + np.repeat(stops - room - ends + counts, counts)] = size - 1
    control = (code.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8).tobytes()
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]].tobytes()
    cuts = np.concatenate(([0], np.cumsum(size, dtype=np.int64)))[np.concatenate(([0], ends))].tolist()
    marks = np.concatenate(([0], stops // 4)).tolist()
    return [control[a:b] for a, b in itertools.pairwise(marks)], [data[a:b] for a, b in itertools.pairwise(cuts)]


def decode_many(control: bytes, data: bytes, counts: np.ndarray) -> np.ndarray:
    """The ranks that ``encode_many`` was given, from all documents' bytes."""
    room = -(-counts // 4) * 4
    used = np.arange(int(room.sum())) - np.repeat(np.cumsum(room) - room, room) < np.repeat(counts, room)
    size = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[used]
    start = np.cumsum(size) - size
    raw = np.frombuffer(data + b"\0\0\0", np.uint8)
    out = raw[start].astype(np.uint32)
    for k in range(1, int(size.max(initial=1))):
        longer = np.flatnonzero(size > k)
        out[longer] |= raw[start[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def id_bytes(tokenizer: str, end_id: int) -> str:
    """The type of ids between stages: two bytes where the vocabulary allows, else four."""
    return "<u2" if max(encoder(tokenizer).library.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"


def tokenised(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids as integers of ``id_bytes``), the end id included."""
    width = id_bytes(tokenizer, end_id)
    kind = id_column(docs, id_col).schema[id_col].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], np.uint32)
        for batch in batches:
            low, n, ids, size = 0, [], [], 0
            for _, own in encoder(tokenizer).encode(batch.column(1)):
                n.append(len(own) + 1)
                ids.append(np.concatenate((own, end)).astype(width).tobytes())
                size += len(ids[-1])
                if size > 8 << 20:
                    yield _batch(batch, low, n, ids, id_col)
                    low, n, ids, size = low + len(n), [], [], 0
            if n:
                yield _batch(batch, low, n, ids, id_col)
        encoder(tokenizer).rest()

    return docs.select(id_col, text_col).mapInArrow(encode, f"`{id_col}` {kind}, n_tokens long, ids binary")


def _batch(batch: pa.RecordBatch, low: int, n: list[int], ids: list[bytes], id_col: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([batch.column(0).slice(low, len(n)), pa.array(n, pa.int64()), pa.array(ids, pa.binary())],
                                      [id_col, "n_tokens", "ids"])


def token_counts(tokens: DataFrame, width: str) -> DataFrame:
    """(token, n) over all documents; a task hands on each id once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for ids in batch.column(0):
                own = np.bincount(np.frombuffer(ids.as_buffer(), width))
                if len(own) > len(total):
                    total = np.concatenate((total, np.zeros(len(own), np.int64)))
                total[: len(own)] += own
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["token", "n"])

    return tokens.select("ids").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id",
                      text_col: str = "text") -> None:
    """Write ``path``/tokens and ``path``/ranks.

    Null and empty texts hold the end id alone; null ids come first; repeated rows are documents of their own,
    side by side; an empty table gives empty files. The ids' number is bounded by the vocabulary.
    """
    width = id_bytes(tokenizer, end_id)
    tokens = materialised(tokenised(docs, tokenizer, end_id, id_col, text_col), "zstd")
    kind = docs.schema[id_col].dataType.simpleString()
    order = sorted(token_counts(tokens, width).collect(), key=lambda r: (-r["n"], r["token"]))  # the vocabulary at most
    spark = docs.sparkSession
    rank_of = np.zeros(max((r["token"] for r in order), default=0) + 1, np.uint32)
    rank_of[[r["token"] for r in order]] = np.arange(len(order))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                some = batch.slice(k, 256)
                n = some.column("n_tokens").to_numpy()
                ids, _ = string_buffers(some.column("ids"))
                control, data = encode_many(rank_of[np.ascontiguousarray(ids).view(width)], n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(n), pa.int32()), pa.array(at + np.cumsum(n) - n), some.column(id_col), some.column("n_tokens"),
                     pa.array(control, pa.binary()), pa.array(data, pa.binary())],
                    ["part", "start_in_part", id_col, "n_tokens", "control", "data"])
                at += int(n.sum())

    cells = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.createDataFrame([(i, r["token"]) for i, r in enumerate(order)], "rank long, token long").coalesce(1).write.parquet(f"{path}/ranks")
    (tokens.repartitionByRange(cells, F.col(id_col).asc_nulls_first()).sortWithinPartitions(F.col(id_col).asc_nulls_first())
     .mapInArrow(encode, f"part int, start_in_part long, `{id_col}` {kind}, n_tokens long, control binary, data binary")
     .write.option("compression", "zstd").parquet(f"{path}/tokens"))
    discard(tokens)


def read_token_files(spark: SparkSession, path: str, id_col: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """(id, start, n_tokens, ids_crc32, ids where wanted): start counts the ids of all documents before."""
    files = spark.read.parquet(f"{path}/tokens")
    rows = spark.read.parquet(f"{path}/ranks").collect()  # the vocabulary at most
    token_of = np.zeros(len(rows), "<u4")
    token_of[[r["rank"] for r in rows]] = [r["token"] for r in rows]
    kind = files.schema[id_col].dataType.simpleString()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                some = batch.slice(k, 256)
                n = some.column("n_tokens").to_numpy()
                raw = token_of[decode_many(*(string_buffers(some.column(x))[0].tobytes() for x in ("control", "data")), n)].tobytes()
                cuts = [0, *(4 * np.cumsum(n)).tolist()]
                ids = [raw[a:b] for a, b in itertools.pairwise(cuts)]
                yield pa.RecordBatch.from_arrays(
                    [*(some.column(x) for x in ("part", "start_in_part", id_col, "n_tokens")),
                     pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array(ids if with_ids else [b""] * len(ids), pa.binary())],
                    ["part", "start_in_part", id_col, "n_tokens", "ids_crc32", "ids"])

    before = (files.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # a row per file
              .select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before")))
    read = files.mapInArrow(decode, f"part int, start_in_part long, `{id_col}` {kind}, n_tokens long, ids_crc32 long, ids binary")
    return read.join(F.broadcast(before), "part").select(id_col, (F.col("before") + F.col("start_in_part")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)
