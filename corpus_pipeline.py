"""The corpus pipeline: from all documents to packed training sequences.

``STAGES`` lists the stages in order; each function takes ``(spark, docs,
sf_dir)`` and returns a frame that is written and read again as the next one's
``docs``.  All but the last return the columns of ``docs`` unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rivulet.llm import exact_dedup, mixing, packing, quality, simhash
from rivulet.llm.common import release, table
from rivulet.session import materialize


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts.

    A null text is judged as the empty text, repeated rows each by their text; an empty table stays empty.
    """
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row, the one with the smallest id.

    Null texts are equal to empty ones; of repeated rows one stays, a null id only where the group has no other.
    """
    return exact_dedup.without_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component, the smallest id.

    Repeated rows and null ids as in ``exact_stage``; texts without words are one component.
    """
    return simhash.one_of_each(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice.

    Repeated rows are taken each by itself; a null text has no words, a null source is one of its own.
    """
    return mixing.mixed(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens.

    A null text is packed as the empty text, a repeated row once more; an empty table gives no pieces.
    """
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("simhash near-dedup", near_stage),
    ("mixing to target weights", mixing_stage),
    ("packing", packing_stage),
]

# The classifier, the seeded choice and the tokenizer can't be stated in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table, each written before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.split()[0])
        release(spark)
    return STAGES[-1][1](spark, docs, sf_dir)
