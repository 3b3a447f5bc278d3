"""Readers of the project's Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomflow.runtime import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
