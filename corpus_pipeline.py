"""The corpus pipeline: five stages over ``documents``, each written and read again.

Quality classifier, MinHash near-dedup, benchmark decontamination, secret scan, byte-level BPE.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tapeloom.llm import bpe, decontam, neardup, quality, secret_scan
from tapeloom.llm.frames import stage
from tapeloom.llm.queries import table, vocabulary_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from the labelled ones among them, scores 0.5 or more."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.keep_good(docs.select(COLUMNS), model)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, with the least id, of each group linked by five-word shingles at 0.8 or more."""
    return neardup.keep_one(docs.select(COLUMNS), shingle=5, percent=80)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no ten-word window of a benchmark item occurs."""
    return decontam.drop_contaminated(docs.select(COLUMNS), table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by a mark."""
    return secret_scan.redact(docs.select(COLUMNS), secret_scan.train(docs))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids (little-endian int32 bytes) of every text."""
    ranks = bpe.read_ranks(vocabulary_path("byte_bpe_multi_50k.tiktoken"))
    return bpe.encode_documents(docs, ranks, public_tokenizers.PATTERN)


STAGES = [
    ("quality classifier", good_documents), ("minhash near-dedup", one_of_each),
    ("benchmark decontamination", without_benchmark), ("secret scans", without_secrets),
    ("byte-level bpe", token_ids),
]
ORACLE_SQL = None  # a trained classifier and merges by rank are not SQL; tests hold it against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, step in STAGES:
        docs = stage(step(spark, docs, sf_dir))
    return docs
