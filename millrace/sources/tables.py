"""Columnar tables under one folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` of ``folder``; Catalyst prunes its columns and pushes filters to the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
