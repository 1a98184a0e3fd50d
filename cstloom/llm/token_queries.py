"""Queries of problems 8 and 9."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cstloom.llm import packing, tokens
from cstloom.session import read_table


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode(read_table(spark, sf_dir, "documents"))


def p8_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text, decoded from its ids."""
    return tokens.decode(p8_ids(spark, sf_dir))


def p9_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    windows = [(r.window_name, r.capacity) for r in read_table(spark, sf_dir, "context_windows").select("window_name", "capacity").distinct().collect()]
    return packing.pack(tokens.token_counts(docs), sorted(windows), n_items=docs.count())


def p9_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers and the share of them in use, by window."""
    boxes = p9_pack(spark, sf_dir).groupBy("window_name", "container").agg(F.sum("length").alias("used"))
    windows = read_table(spark, sf_dir, "context_windows").select("window_name", "capacity").distinct()
    return boxes.groupBy("window_name").agg(F.count("*").alias("containers"), F.sum("used").alias("tokens")).join(F.broadcast(windows), "window_name").select("window_name", "containers", "tokens", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity")), 6).alias("share_used"))


QUERIES = {"p8_ids": p8_ids, "p8_decoded": p8_decoded, "p9_pack": p9_pack, "p9_fill": p9_fill}
