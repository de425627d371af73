"""Readers of the project's tables: one Parquet file or folder for each table below a scale folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ohmgrid.session import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
