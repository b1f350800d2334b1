"""Parquet tables of one data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, where: str, name: str) -> DataFrame:
    """One table of the directory, read with its own schema."""
    return spark.read.parquet(f"{where}/{name}.parquet")
