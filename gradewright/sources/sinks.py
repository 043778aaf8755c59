"""Sinks: partition refresh, keyed upsert, append, JSON documents, and the embedding cache."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradewright.operators.hierarchy import latest_rows


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _fs(spark, path)
    return fs.exists(where)


def refresh(df: DataFrame, path: str, *keys: str) -> None:
    """Replaces exactly the partitions that df has rows for, each at once; all others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def upsert(df: DataFrame, path: str, key: str, *order: str) -> None:
    """Keeps one row a key: the latest of what is stored and what comes. The new table is written beside the old and then takes its place."""
    spark = df.sparkSession
    merged = df
    if exists(spark, path):
        merged = spark.read.parquet(path).unionByName(df)
    beside = f"{path}.{uuid.uuid4().hex[:8]}"
    latest_rows(merged, key, *order).write.parquet(beside)
    fs, where = _fs(spark, path)
    old = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(beside + ".old")
    if fs.exists(where):
        fs.rename(where, old)
    fs.rename(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(beside), where)
    fs.delete(old, True)


def as_document(df: DataFrame, key: str, order: list[str], name: str = "document") -> DataFrame:
    """(key, document): each key's rows as one JSON list, in order. Meant for keys with few rows, such as an exam plan."""
    rest = [c for c in df.columns if c != key]
    items = F.array_sort(F.collect_list(F.struct(*order, *[c for c in rest if c not in order])))
    return df.groupBy(key).agg(F.to_json(items, {"ignoreNullFields": "false"}).alias(name))


def from_document(df: DataFrame, key: str, schema: str, name: str = "document") -> DataFrame:
    """The rows of as_document() again; schema is that of one item."""
    return df.select(key, F.explode(F.from_json(name, f"array<struct<{schema}>>")).alias("_i")).select(key, "_i.*")


def hashing_embedder(dim: int) -> Callable[[list[str]], list[list[float]]]:
    """A deterministic bag-of-words embedder for tests and runs without a model."""
    import re

    import xxhash

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * dim
            for w in re.findall(r"\w+", (t or "").lower()):
                v[xxhash.xxh3_64_intdigest(w) % dim] += 1.0
            norm = sum(x * x for x in v) ** 0.5
            out.append([x / norm for x in v] if norm else v)
        return out

    return embed


def embedded(texts: DataFrame, embed: Callable[[list[str]], list[list[float]]], cache: str, batch: int = 64) -> DataFrame:
    """texts (id, text) with their vectors; every distinct text is embedded once, ever.

    Digests of the texts are looked up in the cache table at ``cache``; ``embed`` runs in the tasks on batches of those missing, whose vectors are
    appended before the join. All vectors must have one length. Null texts get a null vector.
    """
    spark = texts.sparkSession
    keyed = texts.withColumn("digest", F.sha2("text", 256))
    wanted = keyed.filter("text is not null").groupBy("digest").agg(F.any_value("text").alias("text"))
    if exists(spark, cache):
        wanted = wanted.join(spark.read.parquet(cache).select("digest"), "digest", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for a in range(0, len(pdf), batch):
                part = pdf.iloc[a:a + batch]
                vectors = embed(part["text"].tolist())
                if len(vectors) != len(part) or len({len(v) for v in vectors}) > 1:
                    raise ValueError("the embedder must give one vector of one length for every text")
                yield pd.DataFrame({"digest": part["digest"], "embedding": vectors})

    append(wanted.mapInPandas(run, "digest string, embedding array<double>"), cache)
    return keyed.join(spark.read.parquet(cache), "digest", "left").drop("digest")
