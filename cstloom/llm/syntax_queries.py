"""Queries of problem 1."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cstloom.llm import syntax
from cstloom.session import read_table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syntax.invalid_files(read_table(spark, sf_dir, "parse_results"), read_table(spark, sf_dir, "chunks"))


def p1_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syntax.invalid_rates(read_table(spark, sf_dir, "parse_results"), read_table(spark, sf_dir, "chunks"))


QUERIES = {"p1_found": p1_found, "p1_rates": p1_rates}
