"""Queries over the flattened trees (problem 2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cstloom.operators import nested
from cstloom.session import read_table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.child_links(read_table(spark, sf_dir, "cst_documents"))


def p2_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes with their labels, offsets, points and texts."""
    return nested.flatten_trees(read_table(spark, sf_dir, "cst_documents"))


def p2_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sizes of the node tables per type, and how many of their rows relate to a row of another table."""
    return nested.type_counts(nested.flatten_trees(read_table(spark, sf_dir, "cst_documents"), ["file_id", "type", "parent_pre"]))


def p2_identifiers_by_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per file and definition node: how many identifiers its interval contains."""
    n = nested.flatten_trees(read_table(spark, sf_dir, "cst_documents"), ["file_id", "pre", "last", "type"])
    units = n.filter(F.col("type").rlike("(function|method|class).*(definition|declaration|item|specifier)"))
    inside = nested.contained(units, nested.type_table(n, "identifier"))
    return inside.groupBy("file_id", F.col("outer_pre").alias("unit_pre")).agg(F.count("*").alias("n_identifiers"))


QUERIES = {"p2_found": p2_found, "p2_nodes": p2_nodes, "p2_type_counts": p2_type_counts, "p2_identifiers_by_unit": p2_identifiers_by_unit}
