"""A training corpus from raw documents: five operators in a row, each over what the one before kept.

Defined cases: null texts count as empty, and one empty text stays; of repeated rows one stays; rows that share an id but
not a text are documents of their own until near dedup, which keeps or drops an id as a whole; null ids are kept by near
dedup; without usable labels no document is toxic, without benchmark items none leaks; very long texts are read whole;
further columns pass through, but for those that the last stage adds, which replace columns of the same names; an empty
table gives an empty result at each stage.

Stages with Arrow kernels bound the session's Arrow batches by bytes (``bound_batches``), so that an executor's memory
does not grow with the length of 10,000 texts; the session keeps that bound.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from nodeloom.llm import decontamination, exact_dedup, mixing, near_dedup, toxicity
from nodeloom.llm.common import bound_batches, materialize, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted to the labels of these documents, rejects go."""
    bound_batches(spark)
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that differ in white space only, the longest stays, then the smallest id."""
    bound_batches(spark)
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, similarity 0.8 or more; one document of each group stays."""
    bound_batches(spark)
    return near_dedup.deduplicate(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    bound_batches(spark)
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with their size and the words taken of them (repeats counted)."""
    return mixing.take(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("mixing", mix),
]

#: Classifiers, hashing and retrieval have no SQL; the tests hold each stage against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
