"""Queries of problem 6."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cstloom.llm import provenance
from cstloom.session import read_table


def _tables(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    return [read_table(spark, sf_dir, t) for t in ("parse_results", "chunks", "library_index")]


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provenance.not_hand_written(*_tables(spark, sf_dir))


def p6_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file of a supported language with what it is."""
    return provenance.judged_files(*_tables(spark, sf_dir))


QUERIES = {"p6_found": p6_found, "p6_kinds": p6_kinds}
