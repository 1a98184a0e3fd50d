"""Queries of problem 10."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

from cstloom.llm import abuse
from cstloom.session import read_table


def _tables(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    return [read_table(spark, sf_dir, t) for t in ("documents", "moderation_labels", "flagged_terms")]


@lru_cache(2)
def _judge(spark: SparkSession, sf_dir: str) -> abuse.Judge | abuse.ListJudge:
    """The judge of a folder's tables, trained once in a session."""
    return abuse.fit(*_tables(spark, sf_dir))


def p10_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's scores by category and whether it is flagged."""
    return abuse.scored(*_tables(spark, sf_dir), fitted=_judge(spark, sf_dir))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p10_scores(spark, sf_dir).filter("flagged").select("doc_id").distinct()


def p10_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse.rates(p10_scores(spark, sf_dir))


QUERIES = {"p10_found": p10_found, "p10_scores": p10_scores, "p10_rates": p10_rates}
