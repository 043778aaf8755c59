"""Connected components by randomised contraction."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradewright.scratch import Scratch

#: Edges that one task finishes by union-find; contraction goes on until so few are left.
FEW_EDGES = 400_000


def _union(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(u, rep) of every node of the edges, rep being the smallest node of its component."""
    root: dict = {}

    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for pdf in batches:
        for u, v in zip(pdf["u"].tolist(), pdf["v"].tolist()):
            root.setdefault(u, u)
            root.setdefault(v, v)
            a, b = find(u), find(v)
            if a != b:
                root[max(a, b)] = min(a, b)
    nodes = list(root)
    yield pd.DataFrame({"u": nodes, "rep": [find(x) for x in nodes]})


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", few_edges: int = FEW_EDGES) -> DataFrame:
    """(node, component) of every node on an edge; component is the smallest node of its component.

    Each round every vertex joins the neighbour (or itself) of lowest hash under the round's
    salt, and the edges are redrawn between those representatives. A constant share of the vertices
    disappears per round whatever the shape, chains included, so the number of rounds is logarithmic
    and the work of all rounds together is linear. When at most ``few_edges`` edges are left, one task finishes
    them. Nothing is gathered on the driver.

    Nulls: an edge with a null end is left out. Loops make their node a component of its own.
    Repeated edges count once. An empty table gives an empty result.
    """
    spark = edges.sparkSession
    scratch = Scratch(spark, "components")
    all_edges = scratch.write(
        edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).dropna().distinct()
    )
    current = all_edges.filter("u <> v")
    maps: list[DataFrame] = []
    while True:
        if current.count() <= few_edges:
            kind = all_edges.schema["u"].dataType.simpleString()
            last = scratch.write(current.coalesce(1).mapInPandas(_union, f"u {kind}, rep {kind}"))
            if not last.isEmpty():
                maps.append(last)
            break
        salt = len(maps)
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        rank = F.struct(F.xxhash64(F.lit(salt), "v").alias("h"), F.col("v"))
        own = F.struct(F.xxhash64(F.lit(salt), "u").alias("h"), F.col("u").alias("v"))
        step = scratch.write(
            both.groupBy("u").agg(F.min(rank).alias("m")).select("u", F.least(own, F.col("m"))["v"].alias("rep"))
        )
        if step.isEmpty():
            break
        maps.append(step)
        left = step.select("u", F.col("rep").alias("ru"))
        right = step.select(F.col("u").alias("v"), F.col("rep").alias("rv"))
        nxt = (
            current.join(left, "u").join(right, "v")
            .filter("ru <> rv")
            .select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v"))
            .distinct()
        )
        nxt = scratch.write(nxt)
        if len(maps) > 1:
            scratch.drop(current)
        current = nxt
    if not maps:
        labels = all_edges.select(F.col("u").alias("node"), F.col("u").alias("rep")).limit(0)
    else:
        labels = maps[-1].select(F.col("u").alias("node"), "rep")
        for step in reversed(maps[:-1]):
            up = labels.select(F.col("node").alias("rep"), F.col("rep").alias("top"))
            labels = step.select(F.col("u").alias("node"), "rep").join(up, "rep", "left").select(
                "node", F.coalesce("top", "rep").alias("rep")
            )
    loops = all_edges.filter("u = v").select(F.col("u").alias("node"))
    lowest = labels.groupBy("rep").agg(F.min("node").alias("component"))
    named = labels.join(lowest, "rep").select("node", "component")
    alone = loops.join(named, "node", "left_anti").select("node", F.col("node").alias("component"))
    return named.unionByName(alone)
