"""Queries of the training-text problems and their SQL; none can be said in SQL on whole tables, so tests hold them against brute force."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from symbolake.llm import docs_pairs, leaks, mixing, reading, source_kinds
from symbolake.runtime import table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return source_kinds.machine_files(table(spark, d, "symbols"), table(spark, d, "documents")).select("repo", "file_path")


def p3_reasons(spark: SparkSession, d: str) -> DataFrame:
    return source_kinds.machine_files(table(spark, d, "symbols"), table(spark, d, "documents"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return docs_pairs.documented_functions(table(spark, d, "symbols"), table(spark, d, "documents")).select("symbol_id")


def p6_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Each documented function with its description and its source text."""
    return docs_pairs.documented_functions(table(spark, d, "symbols"), table(spark, d, "documents"), code=True)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


def p8_whole_schedule(spark: SparkSession, d: str) -> DataFrame:
    """A mix of all that the repeats allow, in order of service: the parts of every taken document, block by block."""
    return mixing.interleaved(mixing.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"), total=float("inf"))[0])


def p8_schedule(spark: SparkSession, d: str) -> DataFrame:
    """The largest mix that reaches all targets, in order of service."""
    return mixing.interleaved(mixing.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0])


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    """Repeats and actual shares of the largest mix that reaches all targets."""
    return mixing.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p8_whole(spark: SparkSession, d: str) -> DataFrame:
    """Repeats and actual shares of a mix of all that the repeats allow."""
    return mixing.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"), total=float("inf"))[1]


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return reading.reading_levels(table(spark, d, "documents")).select("doc_id", "band").distinct()


QUERIES = {f.__name__: f for f in (p3_found, p3_reasons, p6_found, p6_pairs, p7_found, p8_whole_schedule, p8_schedule, p8_mix, p8_whole, p9_found)}
SQL: dict[str, str] = {}
