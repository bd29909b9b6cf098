"""A training-data pipeline of this library's operators over `documents`.

1. quality: documents that the weak-label classifier rejects, as of low quality or toxic, go.
2. near_copies: of each group of near copies (five-word shingles, similarity 0.8) one document stays.
3. decontaminate: documents that hold ten words in a row of a benchmark item go.
4. personal_data: spans of personal data are replaced by their kind in brackets, n_chars follows.
5. pack: documents become pieces of sequences of 2048 tokens.

Each stage takes all rows that the one before kept. All but the last return the columns of documents. Null
texts go through as empty texts do: they are kept by every stage but near_copies, which keeps one of them.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.llm import common, decontaminate, packing, pii, quality, simhash

TOKENIZER = "word_bpe_49k.json"


def beside(docs: DataFrame, name: str, use: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """use() over the documents, which adds a column of this name that goes again. One that they have
    themselves is put aside meanwhile."""
    free = name
    while free in docs.columns:
        free += "_"
    moved = docs.withColumnsRenamed({name: free}) if free != name else docs
    return use(moved).drop(name).withColumnsRenamed({free: name} if free != name else {}).select(*[f"`{c}`" for c in docs.columns])


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = common.table(spark, sf_dir, "labels")
    return beside(docs, "verdict", lambda d: quality.classify(d, labels).where("verdict.keep"))


def stage_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.deduplicate(docs, 5, 0.8)


def stage_decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    items = common.table(spark, sf_dir, "benchmark")
    return beside(docs, "hits", lambda d: decontaminate.scan(d, items, 10).where("hits.n_hit = 0"))


def stage_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    safe = beside(docs, "pii", lambda d: pii.detect(d, redacted=True))
    return safe.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).otherwise(F.col("n_chars")).cast("long"))


def stage_pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path(TOKENIZER), 1, 2048)


STAGES = [
    ("quality", stage_quality),
    ("near_copies", stage_near_copies),
    ("decontaminate", stage_decontaminate),
    ("personal_data", stage_personal_data),
    ("pack", stage_pack),
]

#: SQL can express neither the classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
