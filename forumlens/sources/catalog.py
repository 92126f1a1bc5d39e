"""Named tables in a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """`name` as stored under `sf_dir`: one Parquet file, or a folder of them, with that name."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
