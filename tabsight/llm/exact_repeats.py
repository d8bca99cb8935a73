"""Removal of repeated byte strings by prefix-free parsing; see ``prefix_free`` for the method."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tabsight.llm.prefix_free import EVERY, WIDE, repeated_windows
from tabsight.llm.runs import Kind, covered, keyed, with_stretches
from tabsight.llm.text import id_column, string_buffers

LENGTH = 400
GRAM = 16


def remove_repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                          gram: int = GRAM, every: int = EVERY, wide: int = WIDE) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept, kept_sha256) per document; kept is the bytes that stay.

    Every byte of a string of ``length`` bytes that also starts elsewhere is removed, in all places. Triggers are of
    ``gram`` bytes (8 at least, at most half of ``length``), one in ``every`` places on average.
    Null, empty and short texts hold no such string; a null id is kept; a row that is repeated is repeated text;
    a text of any length is judged whole; an empty table gives no rows. Other columns are not read.
    """
    kind = Kind("byte", length, gram)
    texts = keyed(id_column(docs, id_col), id_col, text_col)
    marked = with_stretches(texts, repeated_windows(texts, kind, every, wide))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_bytes, n_removed, n_spans, kept = [], [], [], []
            for k in range(batch.num_rows):
                data, _ = string_buffers(batch.column("body").slice(k, 1))
                rows = batch.column("rows").slice(k, 1)
                spans, gone = 0, 0
                if not rows.null_count:
                    runs = rows.flatten()
                    out = covered(*(runs.field(c).to_numpy(zero_copy_only=False) for c in ("start", "n")), length, len(data))
                    gone, spans = int(out.sum()), int(out[0]) + int((out[1:] & ~out[:-1]).sum())
                    n_bytes.append(len(data))
                    data = data[~out]
                else:
                    n_bytes.append(len(data))
                n_removed.append(gone)
                n_spans.append(spans)
                kept.append(data.tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), *(pa.array(x, pa.int64()) for x in (n_bytes, n_removed, n_spans)), pa.array(kept, pa.binary()),
                 pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())],
                ["id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    id_type = texts.schema["id"].dataType.simpleString()
    out = marked.select("id", "body", "rows").mapInArrow(keep, f"id {id_type}, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")
    return out.withColumnRenamed("id", id_col)
