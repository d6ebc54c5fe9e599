"""The corpus pipeline: quality rules, near copies, benchmark passages, secrets, token ids.

Each stage is (name, function of (session, documents, folder of the tables)); a stage's result is written as
Parquet and read again as the next one's documents. All but the last return the columns of documents.
"""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from chronoscribe.llm import common, prefix_tree, quality, secret, sentence, winnow


def _stage(fn):
    """A stage whose texts reach Python workers in batches of bounded size."""
    @functools.wraps(fn)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        common.bounded(spark)
        return fn(spark, docs, sf_dir)

    return run


@_stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass all rules of the current policy."""
    return quality.keep(docs)


@_stage
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents connected by links (Jaccard of 5-word shingles at least 0.8), the one with the smallest id."""
    return prefix_tree.one_of_each(docs, n_words=5, percent=80)


@_stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a run of words of the benchmark."""
    return winnow.drop_hits(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_stage
def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by their kind."""
    return secret.redact(docs)


@_stage
def piece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with the SentencePiece ids of their texts."""
    return sentence.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), ids=common.fresh(docs, "ids"))


STAGES = [("quality rules", quality_rules), ("n-gram Jaccard join", near_copies), ("benchmark decontamination", decontamination),
          ("secret scans", secrets), ("SentencePiece encoding", piece_ids)]

#: Groups of near copies, runs of words and piece ids have no SQL; tests/llm/test_pipeline.py has plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = common.cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
