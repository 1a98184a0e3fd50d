"""Queries of problem 5."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cstloom.llm import near_duplicates as nd
from cstloom.llm.common import functions_of
from cstloom.session import read_table


def _functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return functions_of(read_table(spark, sf_dir, "chunks")).select("chunk_no", "text")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nd.similar_pairs(_functions(spark, sf_dir)).select(F.col("id_a").alias("chunk_a"), F.col("id_b").alias("chunk_b"))


def p5_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every function with its class (same words), the size of the class and the number of other classes like it."""
    members, links = nd.class_links(_functions(spark, sf_dir))
    each = links.select(F.explode(F.array("a", "b")).alias("class")).groupBy("class").agg(F.count("*").alias("like_classes"))
    size = members.groupBy("class").agg(F.count("*").alias("class_size"))
    return members.join(size, "class").join(each, "class", "left").select(F.col("id").alias("chunk_no"), F.col("class").alias("class_id"), "class_size", F.coalesce("like_classes", F.lit(0)).alias("like_classes"))


QUERIES = {"p5_found": p5_found, "p5_classes": p5_classes}
