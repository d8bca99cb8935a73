"""Exact duplicates by deterministic block naming.

Every normalised text is cut into blocks of fixed size. Sorting the blocks gives equal ones one integer name; then
adjacent names of a document are paired and the pairs sorted into names in turn, until each document is left with
one. Two documents have the same level and name only if they are equal byte by byte: no hash decides anything.
All steps are DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabsight.llm.groups import HOT_SHARE, with_groups
from tabsight.llm.text import id_column
from tabsight.sources.files import discard, materialised

BLOCK = 2048

# fixed values: the letters that are lower-cased
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text_col: str):
    """A-Z lower-cased, other letters left alone; a null text is empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    plain = F.octet_length(text) == F.length(text)  # ASCII only: lower() touches nothing else
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def identities(texts: DataFrame, block: int = BLOCK) -> DataFrame:
    """(row, level, name) for a written table (row, body): one identity per row, equal for equal bodies only."""
    last = F.greatest(F.ceil(F.octet_length("body") / block), F.lit(1)).cast("long") - 1
    places = (texts.select("row", "body", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("pos"), (last + 1).alias("size"))
              .select("row", "pos", "size", F.substr("body", (F.col("pos") * block + 1).cast("int"), F.lit(block)).alias("content")))
    names = materialised(_block_names(places))
    done, level = [], 0
    while True:
        done.append(names.filter("size = 1").select("row", F.lit(level).alias("level"), "name"))
        if not names.filter("size > 1").limit(1).count():
            break
        at = F.col("pos") % 2
        pairs = materialised(
            names.filter("size > 1").groupBy("row", "size", F.floor(F.col("pos") / 2).alias("half"))
            .agg(F.max(F.when(at == 0, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(at == 1, F.col("name"))), F.lit(-1)).alias("b")))
        paired = with_groups(pairs, ["a", "b"], [], id_name="name")
        names = materialised(paired.select("row", F.col("half").alias("pos"), F.ceil(F.col("size") / 2).alias("size"), "name"))
        discard(pairs)
        level += 1
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def _block_names(places: DataFrame) -> DataFrame:
    """(row, pos, size, name): blocks are sorted by content, and a run of equal ones is named by its first place.

    Contents that hold more than a thousandth of all blocks are aggregated and their names broadcast, as there are
    fewer than a thousand of them; a hash only tells which blocks to look at there, the join is by content.
    """
    mark = F.xxhash64("content")
    counts = places.groupBy(mark.alias("mark")).agg(F.count(F.lit(1)).alias("n"))
    counts = materialised(counts)
    limit = (counts.agg(F.sum("n")).first()[0] or 0) // HOT_SHARE
    often = [r["mark"] for r in counts.filter(F.col("n") > limit).collect()]  # fewer than HOT_SHARE
    discard(counts)
    numbered = places.withColumn("place", F.monotonically_increasing_id())
    run = Window.partitionBy("content").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rare = numbered.filter(~mark.isin(often)) if often else numbered
    named = rare.select("row", "pos", "size", (F.first("place").over(run) * 2).alias("name"))
    if not often:
        return named
    common = places.filter(mark.isin(often))
    contents = materialised(common.groupBy("content").agg(F.count(F.lit(1)).alias("n")).sortWithinPartitions("content")
                            .select("content", "n", (F.monotonically_increasing_id() * 2 + 1).alias("name")))
    hot, others = contents.filter(F.col("n") > limit), contents.filter(F.col("n") <= limit)
    named = named.unionByName(common.join(F.broadcast(hot), "content").select("row", "pos", "size", "name"))
    return named.unionByName(common.join(F.broadcast(hot), "content", "left_anti").join(others, "content").select("row", "pos", "size", "name"))


def duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) per document; of equal texts that with the largest id stays.

    A null text is empty, and empty texts are equal to each other. Null ids are smaller than all others; of rows with
    the same text and id just one is kept. Texts of any length are compared whole; an empty table gives no rows.
    Other columns are not read.
    """
    body = normalised(text_col)
    texts = materialised(id_column(docs, id_col).select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), body.cast("binary").alias("body"),
        F.sha2(body.cast("binary"), 256).alias("sha")), "zstd")
    own = identities(texts, block)
    rows = materialised(texts.select("row", "id", "sha").join(own, "row"))
    discard(texts)
    found = with_groups(rows, ["level", "name"], [F.max(F.struct("id", "row")).alias("top")])
    return found.select(F.col("id").alias(id_col), F.col("top.id").alias("keep_id"), F.col("n").alias("group_size"),
                        (F.col("row") == F.col("top.row")).alias("kept"), F.col("sha").alias("text_sha256"))


#: The duplicates in DuckDB SQL.
ORACLE = f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS body FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       row_number() OVER (PARTITION BY body ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(body) AS text_sha256
FROM d WINDOW same AS (PARTITION BY body)
"""
