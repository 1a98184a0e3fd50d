"""Queries of problem 3."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cstloom.llm import neighbours
from cstloom.session import read_table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.neighbour_pairs(neighbours.nearest(read_table(spark, sf_dir, "chunk_vectors").select("vec_id", "embedding")))


QUERIES = {"p3_found": p3_found}
