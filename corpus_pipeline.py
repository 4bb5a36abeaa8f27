"""Corpus pipeline over documents: quality, near duplicates, benchmark leaks, encoding.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept: documents that the quality
classifier rejects go, of each near-duplicate component the document of least doc_id stays, documents that share
ten consecutive words with a benchmark item (or a whole shorter item) go, and the rest are encoded. All stages but
the last return the columns of documents. Nulls, empty texts, repeated rows and empty tables are as the operators'
docstrings define them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from storyloom.llm import bpe, decontaminate, jaccard, quality
from storyloom.llm.common import cut
from storyloom.llm.queries import tokenizer

#: Cached strings of a worker that encodes: fewer than bpe's own number, as earlier stages' buffers are still held.
CACHE = 200_000


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of the top grade reaches the classifier's limit."""
    return quality.select(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of the n-gram Jaccard join."""
    return jaccard.deduplicate(docs)


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids) of every document."""
    return bpe.encode(docs, tokenizer("byte_bpe_multi_50k.tiktoken"), cache=CACHE)


STAGES = [("quality classifier", good_quality), ("n-gram Jaccard join", without_near_duplicates), ("benchmark decontamination", without_leaks), ("byte-level BPE", encoded)]
#: SQL expresses neither the classifier nor the rank merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
