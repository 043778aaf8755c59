"""Tables written to the folder that all executors share.

A written table cuts lineage and outlives the executor that wrote it. The folder is the
cluster's ``spark.checkpoint.dir``; only a local session (tests, a laptop) where that is unset
gets one of its own. A cluster without it is refused, as its executors could not read each other's tables.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from gradewright import ship

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="gradewright-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """The written tables of one operator call."""

    def __init__(self, spark: SparkSession, name: str):
        ship.ensure(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/gradewright/{name}-{uuid.uuid4().hex[:12]}"
        self._n = 0
        _written.append((spark, self.root))

    def write(self, df: DataFrame, partitions: int | None = None) -> DataFrame:
        """df, written now and read from the shared folder from here on."""
        self._n += 1
        path = f"{self.root}/t{self._n}"
        if partitions:
            df = df.coalesce(partitions)
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Frees a table that no later step reads."""
        path = getattr(df, "_scratch_path", None)
        if path:
            _delete(self.spark, path)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # the session is gone; the cluster's cleaner has the folder
            pass
