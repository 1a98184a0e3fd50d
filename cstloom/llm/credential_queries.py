"""Queries of problem 7."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cstloom.llm import credentials
from cstloom.session import read_table


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials.in_chunks(read_table(spark, sf_dir, "chunks")).unionByName(credentials.in_trees(read_table(spark, sf_dir, "cst_documents")))


def p7_masked_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials.masked_chunks(read_table(spark, sf_dir, "chunks"))


def p7_masked_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials.masked_nodes(read_table(spark, sf_dir, "cst_documents"))


QUERIES = {"p7_found": p7_found, "p7_masked_chunks": p7_masked_chunks, "p7_masked_nodes": p7_masked_nodes}
