"""The queries of this subpackage: thin forms of its operators over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.llm import chat, common, decontaminate, language_model, neighbours, packing, pii, quality, simhash, sstable, substrings

BYTE_TOKENIZER = "byte_bpe_50k.json"
WORD_TOKENIZER = "word_bpe_49k.json"


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.group(common.table(spark, sf_dir, "documents"))


def op2_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = common.workspace(spark, "token-shards")
    shards = sstable.write_shards(common.table(spark, sf_dir, "documents"), folder, public_tokenizers.path(BYTE_TOKENIZER), 2)
    return sstable.read_shards(spark, folder, shards).select("doc_id", "start", "n_tokens", "ids_crc32")


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], turns.schema)
    return chat.digests(chat.windows(turns.union(extra), public_tokenizers.path(BYTE_TOKENIZER)))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.scan(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"), 10, carry=["doc_id"])
    names = F.array_join(F.array_sort(F.transform("hits.items", lambda i: i.cast("string"))), ",")
    return found.select("doc_id", "hits.n_words", "hits.n_hit", F.size("hits.items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (F.col("hits.n_hit") > 0).alias("contaminated"))


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove(common.table(spark, sf_dir, "documents"), 200)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.classify(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"), carry=["doc_id"])
    return found.select("doc_id", "verdict.low_quality", "verdict.toxic", "verdict.keep")


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(common.table(spark, sf_dir, "documents"))


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(common.table(spark, sf_dir, "embeddings"), 20, every=20)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(common.table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(common.table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_TOKENIZER), 1, 2048)


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_token_shards": op2_token_shards,
    "op3_chat": op3_chat,
    "op4_decontaminate": op4_decontaminate,
    "op5_substrings": op5_substrings,
    "op6_quality": op6_quality,
    "op7_language_model": op7_language_model,
    "op8_neighbours": op8_neighbours,
    "op9_pii": op9_pii,
    "op10_packing": op10_packing,
}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: Where SQL can express a query; the others are held against brute force in the tests.
ORACLE_SQL: dict[str, str] = {
    "op4_decontaminate": f"""WITH it AS (SELECT item_id, {_WORDS} AS w FROM benchmark), iw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS s FROM it, LATERAL (SELECT unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i) WHERE len(w) > 0),
 dw AS (SELECT doc_id, {_WORDS} AS w FROM documents), ns AS (SELECT DISTINCT n FROM iw), win AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s FROM dw, ns, LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS i)),
 hit AS (SELECT doc_id, i, n, item_id FROM win JOIN iw USING (n, s)), words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
 items AS (SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS name FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
}
