"""Stages of the corpus pipeline: each takes (spark, docs, sf_dir); all but the last return the columns of docs."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import discard, store, table

#: Documents are near-duplicates from this similarity of their sets of five words on; the query op1 has its own default.
NEAR_PERCENT = 80

Stage = tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold."""
    from .toxicity import without_toxic

    return without_toxic(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that an earlier one keeps; confirmed near-duplicates of documents are left to the next stage."""
    from .line_dedup import without_repeated_lines

    return without_repeated_lines(docs, NEAR_PERCENT)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, by its text: rows of one doc_id with different texts are told apart; rows without doc_id, which no group can name, stay."""
    from .near_dedup import without_near_duplicates

    return without_near_duplicates(docs, NEAR_PERCENT)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; the last time perhaps its first words only."""
    from .mixing import mixed_documents

    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens in windows."""
    import public_tokenizers

    from .packing import pack

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


def run(spark: SparkSession, sf_dir: str, stages: Sequence[Stage]) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in stages:
        after = store(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(docs)
        docs = after
    return docs
