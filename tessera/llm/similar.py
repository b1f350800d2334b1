"""Queries of nearest vectors (problem 2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.neighbours import knn_pairs
from tessera.sources.tables import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of chunks of which one is among the 5 nearest of the other."""
    return knn_pairs(table(spark, sf_dir, "chunks"))


QUERIES = {"p2_found": p2_found}
SQL: dict[str, str] = {}
