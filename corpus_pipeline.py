"""Corpus pipeline: language ID, quality, near-duplicates, decontamination, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. The first four return
the columns of documents; the last returns the tokens of each document and the digest of what they decode to.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from haetae.llm import bpe, decontaminate, language_id, quality, simhash
from haetae.llm.common import delete, read_table, shared_dir
from haetae.llm.queries import tokenizer_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter and texts far from every language that ``documents`` labels."""
    return language_id.keep_identified(docs, language_id.fit(read_table(spark, sf_dir, "documents")))


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts whose calibrated quality score is under 0.3."""
    return quality.keep_good(docs, quality.fit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each component of linked fingerprints."""
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts in which a window of a benchmark item occurs."""
    return decontaminate.keep_clean(docs, read_table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256."""
    import public_tokenizers

    return bpe.digests(docs, tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("language_id", identify_language),
    ("quality", classify_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("byte_bpe", tokenize),
]
#: Hashing, compression and learnt models: not SQL. Tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each result is written as Parquet in the shared checkpoint folder and read again.

    A stage's texts are deleted once the next one is written; the last one's rows stay for the reader.
    """
    docs, base = read_table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
        if before:
            delete(spark, before)
        before = f"{base}/{name}"
    return docs
