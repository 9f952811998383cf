"""The registered queries of the corpus operators, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import mixing, quality
from lodestone.llm.common import table


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.secrets import digests

    return digests(table(spark, sf_dir, "documents"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.near import similar

    return similar(table(spark, sf_dir, "documents"), k=3, percent=90)


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.html import extract

    return extract(table(spark, sf_dir, "pages"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.repeats import remove

    return remove(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op7_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.fingerprint import fingerprints

    return fingerprints(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.language import identify

    return identify(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_secret_scans, op2_best_fit_packing, op3_jaccard_join, op4_html_extraction, op5_substring_dedup, op6_quality_rules, op7_document_fingerprints, op8_language_id, op9_mixing, op10_token_counts)}

ORACLE_SQL: dict[str, str] = {"op6_quality_rules": quality.oracle_sql(), "op9_mixing": mixing.oracle_sql()}
