"""Queries of problem 4."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cstloom.llm import documentation
from cstloom.session import read_table


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documentation.documented(read_table(spark, sf_dir, "chunks")).select("chunk_no")


def p4_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documentation.pairs(read_table(spark, sf_dir, "chunks"))


QUERIES = {"p4_found": p4_found, "p4_pairs": p4_pairs}
