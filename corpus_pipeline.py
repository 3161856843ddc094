"""Corpus pipeline: the stages of a training corpus, each over all its predecessor kept.

The stages leave the session with a lower limit of what Spark sends Python at once (``small_batches``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from glimmer.llm.common import cut, dropped, small_batches, table
from glimmer.llm.minhash import one_of_each
from glimmer.llm.packing import pack
from glimmer.llm.quality import good_documents
from glimmer.llm.toxicity import clean_documents

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality classifier rejects.

    Each row is judged by its own text, in the pass that scores it: rows with a null or repeated doc_id too. Null and
    empty texts are scored as texts of no words. Extra columns stay; an empty table gives none.
    """
    small_batches(spark)
    return good_documents(docs, table(spark, sf_dir, "labels"))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the toxicity classifier rejects.

    Each row is judged by its own text, in the pass that scores it: rows with a null or repeated doc_id too. Null and
    empty texts are scored as white space. Extra columns stay; an empty table gives none.
    """
    small_batches(spark)
    return clean_documents(docs, table(spark, sf_dir, "labels"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest doc_id, one row of it.

    Rows with a null doc_id, and texts that are null or without words, link with nothing and stay; repeated rows of one
    doc_id become one. Extra columns stay; an empty table gives none.
    """
    small_batches(spark)
    return one_of_each(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences; each row is a document, whatever its doc_id, a null text an empty one.

    Repeated rows are documents of their own and packed as often as they come; of equally good cuts the first found is
    taken. Extra columns are dropped; an empty table gives no rows.
    """
    small_batches(spark)
    return pack(docs).drop("ids")


STAGES: list[tuple[str, Stage]] = [("quality", quality_stage), ("toxicity", toxicity_stage), ("minhash", dedup_stage), ("packing", packing_stage)]

#: Learned scores have no SQL; the tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces that come out of all stages over ``documents``; a stage's table is deleted once the next one's is written."""
    docs, last = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
        if last is not None:
            dropped(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
