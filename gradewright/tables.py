"""Reading the project's tables from a directory of parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gradewright import ship


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of the directory."""
    ship.ensure(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
