"""A training corpus from documents: quality, near-duplicates, repeated passages, the mix of sources, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; docs is what the stage before kept, written as Parquet and read again.
All but the last return the columns of documents. n_chars follows the text where a stage changes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.llm import bpe_chunks, poisson_mix, quality_trees, simhash_dedup, substring_dedup
from storyloom.llm.common import documents, drop_stashes, small_batches, stash

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; it is fitted to the labels beside the input."""
    small_batches(spark)
    return quality_trees.keep_good(docs, documents(spark, sf_dir, "labels")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates."""
    small_batches(spark)
    return simhash_dedup.keep_representatives(docs).select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages that stand in an earlier one."""
    small_batches(spark)
    return substring_dedup.deduplicated(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources ask for, in shuffled order."""
    return poisson_mix.mixed(docs).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each document of the mix, with the count and digest of its tokens and of their decoded text."""
    small_batches(spark)
    return bpe_chunks.encoded(docs, keep=["doc_id", "source"])


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("source_mix", source_mix),
    ("tokens", tokens),
]

#: Trees, fingerprints, rolling hashes and tokens are not SQL; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again; what a stage leaves behind goes when the next one has it."""
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir))
        drop_stashes(spark, keep=[docs])
    return STAGES[-1][1](spark, docs, sf_dir)
