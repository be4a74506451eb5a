"""A training corpus from raw documents: quality, near-duplicates, personal data, mix, packed sequences.

Every stage works on all that the stage before it kept.  All but the last return the columns of the
documents; the last returns the place of every piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfline.llm import mixing, near_copies, packing, pii, quality
from shelfline.llm.common import discard, noted, stored
from shelfline.sources.star import read_table


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    return quality.keep_good(docs, read_table(spark, sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: linked by SimHash or keys of shingles, and by count at least 0.8 alike."""
    return near_copies.keep_one(docs)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data, plain or disguised, becomes its kind."""
    return pii.redact(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; a row for each time the mix takes a document."""
    return mixing.mixed_documents(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their place in a training sequence."""
    return packing.pack(docs)


STAGES = [
    ("quality", good_documents),
    ("near_duplicates", one_of_each),
    ("personal_data", without_personal_data),
    ("mixing", mixed_sources),
    ("packing", packed_sequences),
]

#: The classifier, the transducers and the tokenizer are no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read by the next.

    When a stage is written, what it made on the way and what it read go; what the last stage reads stays.
    """
    docs, read = read_table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        with noted() as made:
            docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(spark, [*read, *made[:-1]])
        read = made[-1:]
    return STAGES[-1][1](spark, docs, sf_dir)
