"""Readers of the driver tables: one Parquet table per name under a folder or store URI."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` under `sf_dir`, read by Spark alone, so any store URI works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
