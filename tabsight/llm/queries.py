"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsight.llm import additive_model, block_naming, conversation_repair, decontaminate, exact_repeats, filter_audit, jaccard_join, packing, quality_rules, sharding, substring_dedup, token_files, url_filter
from tabsight.sources.files import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def byte_bpe() -> str:
    """The file of the public byte-level tokenizer."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: (verdict, rule): a host with all its subdomains, and the start of a path.
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


@_query
def op1_markov_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages"), URL_RULES).withColumn("score", F.floor("score"))


@_query
def op2_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "rule", "kept")


@_query
def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark)
    token_files.write_token_files(_table(spark, sf_dir, "documents"), folder, byte_bpe(), end_id=2)
    return token_files.read_token_files(spark, folder, with_ids=False)


@_query
def op4_hash_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    docs = _table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    placed = sharding.assign_shards(docs, "doc_id", 16, ("size", "text_crc32"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@_query
def op5_lsh_forest_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(_table(spark, sf_dir, "documents"))


@_query
def op6_additive_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return additive_model.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@_query
def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), byte_bpe(), end_id=0, capacity=2048)


@_query
def op8_super_kmer_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(_table(spark, sf_dir, "documents")).drop("kept")


@_query
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), unnamed=True)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
                        decontaminate.is_contaminated().alias("contaminated"))


@_query
def op10_prefix_free_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_repeats.remove_repeated_bytes(_table(spark, sf_dir, "documents")).drop("kept")


@_query
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = _table(spark, sf_dir, "conversations")
    rows = conversation_repair.damaged(conversations)
    found = conversation_repair.edits(rows)
    shas = conversation_repair.digests(conversation_repair.repaired(rows, found))
    own = lambda df, name: df.withColumnRenamed("conv_id", name)
    out = (conversations.select("conv_id").distinct()
           .join(own(found, "found_id"), F.col("conv_id").eqNullSafe(F.col("found_id")), "left")
           .join(own(shas, "sha_id"), F.col("conv_id").eqNullSafe(F.col("sha_id")), "left"))
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


@_query
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(filter_audit.mask_counts(spark, f"{sf_dir}/documents.parquet", _table(spark, sf_dir, "labels")))


@_query
def op13_block_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_naming.duplicates(_table(spark, sf_dir, "documents"))


ORACLES["op12_filter_audit"] = filter_audit.ORACLE
ORACLES["op13_block_naming"] = block_naming.ORACLE
ORACLES["op1_markov_url_filter"] = url_filter.oracle(URL_RULES)

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES["op9_decontamination"] = f"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
p AS (SELECT DISTINCT item, array_to_string(w[k : k + 12], ' ') AS window_words, least(len(w), 13) AS n
      FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS k FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM p),
t AS (SELECT doc_id, k, n, array_to_string(w[k : k + n - 1], ' ') AS window_words
      FROM (SELECT doc_id, w, n, unnest(range(1, CAST(len(w) - n + 2 AS BIGINT))) AS k FROM d, sizes)),
h AS (SELECT t.doc_id, t.k, t.n, p.item FROM t JOIN p USING (window_words, n)),
hit AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS j FROM h) GROUP BY doc_id),
own AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN own USING (doc_id)
"""

ORACLES["op8_super_kmer_dedup"] = """
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents),
t AS (SELECT doc_id, k, array_to_string(w[k : k + 12], ' ') AS window_words
      FROM (SELECT doc_id, w, unnest(range(1, CAST(len(w) - 11 AS BIGINT))) AS k FROM d)),
f AS (SELECT window_words, min(doc_id) AS first_doc FROM t GROUP BY window_words),
gone AS (SELECT DISTINCT doc_id, unnest(range(k, k + 13)) AS j FROM t JOIN f USING (window_words) WHERE first_doc < doc_id),
words AS (SELECT doc_id, j, w[j] AS word FROM (SELECT doc_id, w, unnest(range(1, CAST(len(w) + 1 AS BIGINT))) AS j FROM d)),
kept AS (SELECT doc_id, count(*) AS n_kept, string_agg(word, ' ' ORDER BY j) AS body
         FROM words ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n_kept, 0) AS BIGINT) AS n_removed, sha256(coalesce(body, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
