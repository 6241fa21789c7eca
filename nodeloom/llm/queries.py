"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from nodeloom.llm import chat, decontamination, exact_dedup, language_id, mixing, near_dedup, pii, suffix_dedup, toxicity, warc
from nodeloom.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_digests(chat.with_forged(spark, table(spark, sf_dir, "conversations")))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.span_digests(table(spark, sf_dir, "documents"))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), size=2)


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.cut_digests(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.fit(docs))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.capture_digests(warc.round_trip(table(spark, sf_dir, "pages")))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_chat_formatting, op2_pii, op3_minhash_near_dedup, op4_source_mixing, op5_decontamination, op6_toxicity, op7_suffix_dedup, op8_language_id, op9_exact_dedup, op10_warc)}
SQL: dict[str, str] = {"op1_chat_formatting": chat.SQL, "op3_minhash_near_dedup": near_dedup.SQL, "op4_source_mixing": mixing.SQL, "op9_exact_dedup": exact_dedup.SQL, "op10_warc": warc.SQL}
