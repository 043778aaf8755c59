"""Session defaults of the engine: UTC, adaptive execution, Arrow exchange."""

from __future__ import annotations

from pyspark.sql import SparkSession

from gradewright import ship

#: Settings every query relies on; deployment settings (memory, partitions) stay with the caller.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("gradewright")
    for name, value in DEFAULTS.items():
        builder = builder.config(name, value)
    builder = builder.config("spark.sql.shuffle.partitions", str(partitions)).config("spark.driver.memory", memory)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship.ensure(spark)
    return spark
