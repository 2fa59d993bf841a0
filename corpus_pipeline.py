"""From raw documents to token ids, in stages that hand over Parquet.

Each stage takes (spark, docs, sf_dir) and works on all documents that the stage before
kept. All but the last return documents with their columns; the last returns each
document's ids.

Defined results: a null text counts as empty, is scored and deduplicated like one, and has
no ids; rows with a null id are kept, and near-duplicates of others only if their ids
aren't null; rows that repeat id and text are copies, of which one stays; rows that repeat
only the id are documents of their own, but near-dedup joins their groups and drops an id
as a whole; a document that the mix takes several times has as many rows; an empty table
gives no rows; further columns of documents are kept up to the last stage, which returns
its own columns alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quiverine.llm import bpe, exact_dedup, mixing, near_dedup, quality
from quiverine.llm.common import Scratch, documents


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.keep_first(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five words, a similarity of 0.8 or more."""
    return near_dedup.keep_first(docs, near_dedup.Near(width=5, percent=80))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, in training order."""
    return mixing.mixed(docs, fill=True)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's token ids, their count and digest, and whether decoding them gives the text again."""
    return bpe.encoded(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", good_quality),
    ("exact dedup", without_copies),
    ("near dedup", without_near_copies),
    ("mixing sources", mixed_sources),
    ("BPE encoding", token_ids),
]

#: No SQL for a fitted classifier and BPE merges; the stages are tested against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's result is written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = documents(spark, sf_dir)
    for number, (_, stage) in enumerate(STAGES):
        docs = scratch.table(stage(spark, docs, sf_dir), f"stage-{number}")
        if number:
            scratch.drop(f"stage-{number - 1}")
    return docs
