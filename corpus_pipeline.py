"""From raw documents to token ids: quality, exact copies, near copies, mixture, encoding.

Every stage works on all that the one before kept. All but the last return the columns of documents; the last
gives each document's ids as digests and counts.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from flowloom.llm import bpe_trie, corpus, exact_dedup, minhash, mixing, quality, scratch
from flowloom.session import prepare


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    labels = prepare(spark).read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs, labels, corpus.HOST, corpus.PATH)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    prepare(spark)
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    prepare(spark)
    return minhash.keep_one(docs, threshold=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A mixture of four fifths of the words, by weight and without repeating any document."""
    prepare(spark)
    return mixing.mix(docs, corpus.LEVELS, corpus.WEIGHTS, fraction=0.8, max_epochs=1, seed=17, whole_rows=True)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    prepare(spark)
    vocabulary = public_tokenizers.path(corpus.VOCABULARY)
    return bpe_trie.digests(bpe_trie.round_trip(docs, vocabulary, release=True))  # the workers serve other stages too


STAGES = [("quality", keep_quality), ("exact copies", drop_copies), ("near copies", drop_near_copies), ("mixture", mix_sources), ("encoding", encode)]
#: The classifier, the signatures and the encoding are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each but the last written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.materialize(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
