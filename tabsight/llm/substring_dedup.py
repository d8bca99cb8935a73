"""Substring deduplication by super-k-mers: a passage stays in the first document that holds it.

A window is 13 consecutive words. Consecutive windows with one minimiser (of five-word grams) travel as one packed
string to the minimiser's bucket, where sorting tells which windows also start in a document with a smaller id.
All words of such windows are removed. See ``runs`` for how buckets are kept small.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsight.llm.runs import WIDE, Kind, covered, keyed, repeated_windows, with_stretches
from tabsight.llm.text import all_columns, id_column, own_name, string_buffers, words_of

WINDOW = 13
GRAM = 5


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM,
                   wide: int = WIDE) -> DataFrame:
    """(id, n_words, n_removed, kept, kept_sha256) per document; kept is the kept words one space apart.

    Words are runs without ASCII white space. The id is a whole number; null ids count as larger than all others,
    and repeated rows or ids, which are not smaller than themselves, take no words from each other. Null, empty
    and blank texts have no words; a text of any length is judged whole; an empty table gives no rows. Other
    columns are not read.
    """
    kind = Kind("word", window, gram)
    texts = keyed(id_column(docs, id_col), id_col, text_col)
    marked = with_stretches(texts, repeated_windows(texts, kind, earlier=True, wide=wide))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            for k in range(batch.num_rows):
                data, offsets = string_buffers(batch.column("body").slice(k, 1))
                starts, ends, _ = words_of(data, offsets)
                words = data.tobytes().split()
                rows = batch.column("rows").slice(k, 1)
                if rows.null_count:
                    gone = 0
                else:
                    runs = rows.flatten()
                    out = covered(*(runs.field(c).to_numpy(zero_copy_only=False) for c in ("start", "n")), window, len(starts))
                    gone = int(out.sum())
                    words = [words[i] for i in np.flatnonzero(~out).tolist()]
                n_words.append(len(starts))
                n_removed.append(gone)
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array([x.decode() for x in kept], pa.string()),
                 pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())],
                ["id", "n_words", "n_removed", "kept", "kept_sha256"])

    id_type = texts.schema["id"].dataType.simpleString()
    out = marked.select("id", "body", "rows").mapInArrow(keep, f"id {id_type}, n_words long, n_removed long, kept string, kept_sha256 string")
    return out.withColumnRenamed("id", id_col)


def trimmed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with all their columns; texts that lose words become their kept words one space apart."""
    kind = Kind("word", WINDOW, GRAM)
    key = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    texts = keyed(docs, id_col, text_col)
    stretches = repeated_windows(texts, kind, earlier=True)
    own_key, own_id, other_key, own_rows = (own_name(docs, c) for c in ("__key", "__id", "__tkey", "__rows"))
    lists = (stretches.groupBy("id", "tkey").agg(F.collect_list(F.struct("start", "n")).alias("rows"))
             .select(F.col("id").alias(own_id), F.col("tkey").alias(other_key), F.col("rows").alias(own_rows)))
    joined = docs.withColumn(own_key, key).join(lists, (F.col(own_key) == F.col(other_key)) & F.col(id_col).eqNullSafe(F.col(own_id)), "left")

    names = docs.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            texts = batch.column(at).to_pylist()
            for k in range(batch.num_rows):
                rows = batch.column(own_rows).slice(k, 1)
                if not rows.null_count:
                    words = texts[k].encode().split()
                    runs = rows.flatten()
                    out = covered(*(runs.field(c).to_numpy(zero_copy_only=False) for c in ("start", "n")), WINDOW, len(words))
                    texts[k] = b" ".join([words[i] for i in np.flatnonzero(~out).tolist()]).decode()
            columns = [pa.array(texts, pa.string()) if c == text_col else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(columns, names)

    return joined.select(*all_columns(docs), own_rows).mapInArrow(cut, docs.schema)
