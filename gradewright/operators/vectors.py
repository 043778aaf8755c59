"""Cosine search and near-duplicate classes over vectors."""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradewright.operators.graph import FEW_EDGES, connected_components
from gradewright.scratch import Scratch
from gradewright.skew import lookup

#: Queries that travel to the data at a time.
QUERY_BLOCK = 4096
#: What a copy of a vector in a table costs, in comparisons.
COPY_COST = 1_000
#: Cosines as near as this to a threshold are decided without the rounding of scaled vectors.
ROUNDING = 1e-9


def hashed_embedding(dim: int):
    """A column function: the words (runs of a-z and 0-9, lower-cased) of a text counted in ``dim`` cells by their digest; null for null."""

    @F.pandas_udf("array<double>")
    def embed(texts: pd.Series) -> pd.Series:
        cells: dict[str, int] = {}

        def one(text):
            if text is None:
                return None
            v = np.zeros(dim)
            for w in re.findall("[a-z0-9]+", text.lower()):
                at = cells.get(w)
                if at is None:
                    at = cells[w] = int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % dim
                v[at] += 1
            return v

        return texts.map(one)

    return embed


def dimension_rejects(rows: DataFrame, dim: int) -> DataFrame:
    """(id, reason) of the rows (id, embedding) that have no vector or one of another length, or one with a null or NaN in it; the others may be searched."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x))
    reason = F.when(F.col("embedding").isNull(), "missing").when(F.size("embedding") != dim, "dimension").when(bad, "value")
    return rows.select("id", reason.alias("reason")).filter("reason is not null")


def _raw(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows and their lengths; zero rows have length 1."""
    n = len(vectors)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    m = flat.reshape(n, -1) if n else np.empty((0, 0))
    norm = np.linalg.norm(m, axis=1) if n else np.ones(0)
    return m, np.where(norm == 0, 1, norm)


def _matrix(vectors: pa.Array) -> np.ndarray:
    """Rows scaled to length 1; zero rows stay zero."""
    m, norm = _raw(vectors)
    return m / norm[:, None]


def _keyed(rows: DataFrame, within: str | None) -> DataFrame:
    """(id, w, embedding); w tells apart what may be compared."""
    w = F.xxhash64(within) if within else F.lit(0).cast("long")
    kept = rows if within is None else rows.filter(F.col(within).isNotNull())
    return kept.select(F.col("id").cast("long").alias("id"), w.alias("w"), "embedding").filter("id is not null and embedding is not null")


def search(queries: DataFrame, rows: DataFrame, k: int, min_cos: float | None = None, within: str | None = None, same_ids: bool = True) -> DataFrame:
    """(query_id, id, cos, rank): the k rows of highest cosine for each query, above ``min_cos`` if given.

    queries and rows are (id, embedding[, within]); with ``within`` only rows of the query's own value of that column count, and nulls there are left out. With ``same_ids``
    ids of both mean the same things, and a query is not found itself. The queries, a stated set, go to the rows in blocks of QUERY_BLOCK, of which
    the driver holds one; each batch of rows keeps its k best a query, and a window merges them. Exact: no index. Ties go to the smaller
    id. Null vectors are left out; a zero vector has cosine 0 with all. All vectors have one length.
    """
    rows = _keyed(rows, within)

    def part(block: list) -> DataFrame:
        q = _matrix(pa.array([r["embedding"] for r in block], pa.list_(pa.float64())))
        qid, qw = np.array([r["id"] for r in block]), np.array([r["w"] for r in block])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own, w = batch.column("id").to_numpy(), batch.column("w").to_numpy()
                some = np.flatnonzero(np.isin(qw, w))
                if not len(own) or not len(some):
                    continue
                cos = q[some] @ _matrix(batch.column("embedding")).T
                cos[qw[some][:, None] != w[None, :]] = -np.inf
                if same_ids:
                    cos[qid[some][:, None] == own[None, :]] = -np.inf
                if min_cos is not None:
                    cos[cos < min_cos] = -np.inf
                order = np.lexsort((np.broadcast_to(own, cos.shape), -cos), axis=1)[:, :k]
                best = np.take_along_axis(cos, order, axis=1)
                x, y = np.nonzero(best > -np.inf)
                yield pa.RecordBatch.from_arrays([pa.array(qid[some][x]), pa.array(own[order[x, y]]), pa.array(best[x, y])], ["query_id", "id", "cos"])

        return rows.mapInArrow(run, "query_id long, id long, cos double")

    parts, block, scratch = [], [], None
    for r in _keyed(queries, within).orderBy("w", "id").toLocalIterator():
        if len(block) == QUERY_BLOCK:
            scratch = scratch or Scratch(queries.sparkSession, "search")
            parts.append(scratch.write(part(block)))
            block = []
        block.append(r)
    if block:
        parts.append(part(block))
    if not parts:
        parts = [rows.limit(0).select(F.col("id").alias("query_id"), "id", F.lit(0.0).alias("cos"))]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("cos"), "id"))
    return out.withColumn("rank", place.cast("long")).filter(F.col("rank") <= k)


def table_plan(n: int, min_cos: float, recall: float) -> tuple[int, int]:
    """(bits, tables) of least cost for n vectors: as many tables as bring a pair at ``min_cos`` together with a probability of ``recall``.

    Two vectors at an angle of t agree in a random sign with 1 - t / pi. No bits and one table is the comparison of all with all, cheapest up to some ten thousand.
    """
    agree = 1 - math.acos(min_cos) / math.pi
    best, least = (0, 1), float(n)
    for bits in range(1, 25):
        tables = math.ceil(math.log(1 - recall) / math.log(1 - agree ** bits))
        cost = tables * (n / 2 ** bits + COPY_COST)
        if cost < least:
            best, least = (bits, tables), cost
    return best


def _exact_to(min_cos: float, recall: float) -> int:
    """The most vectors that table_plan() compares all with all."""
    return bisect.bisect_left(range(1 << 30), True, lo=1, key=lambda n: table_plan(n, min_cos, recall)[0] > 0) - 1


def _reaching(m: np.ndarray, norm: np.ndarray, left: np.ndarray, right: np.ndarray, min_cos: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of left and right with cosine >= min_cos. Near the threshold, dot / (length * length) decides, which rounds no count."""
    cos = (m[left] / norm[left, None]) @ (m[right] / norm[right, None]).T
    x, y = np.nonzero(cos >= min_cos - ROUNDING)
    sure = cos[x, y] >= min_cos + ROUNDING
    unsure = np.flatnonzero(~sure)
    for at in np.array_split(unsure, len(unsure) // 100_000 + 1):
        a, b = left[x[at]], right[y[at]]
        sure[at] = np.einsum("ij,ij->i", m[a], m[b]) / (norm[a] * norm[b]) >= min_cos
    return left[x[sure]], right[y[sure]]


def near_links(rows: DataFrame, min_cos: float, within: str | None = None, recall: float = 0.999, block: int = 2048, seed: int = 7, plan: tuple[int, int] | None = None) -> DataFrame:
    """(u, v), u < v: pairs of rows (id, embedding[, within]) with cosine >= min_cos.

    The rows of one value of ``within`` are compared all with all, which is exact, where that costs less than tables; values of few rows share a task. For the others,
    random hyperplanes sign each vector in several tables; vectors of equal signs in one are compared exactly. Bits and tables follow from the rows of the largest
    value and the wanted recall at ``min_cos`` (pairs above are found more surely); where the signs turn out to tell too little apart, all are compared with all after all. Buckets are cut
    into blocks that meet pairwise, so a hot bucket is spread, and only true links leave a task. Null vectors are left out; zero vectors link to nothing.
    """
    scratch = Scratch(rows.sparkSession, "links")
    rows = scratch.write(_keyed(rows, within).dropDuplicates(["id"]))
    exact_to = (1 << 62 if not plan[0] else 0) if plan else _exact_to(min_cos, recall)
    own = scratch.write(rows.groupBy("w").agg(F.count("*").alias("n")).withColumn("tabled", F.col("n") > exact_to))
    most, few = own.agg(F.max("n"), F.sum(F.when(F.col("n") <= block, F.col("n")))).first()
    cells = math.ceil((few or 0) / block) or 1

    def spread(placed: DataFrame) -> DataFrame:
        """Rows (key, g, n) of n that meet under a key, once for each pair of blocks i, j that their own block b is in."""
        cut = placed.withColumn("parts", F.ceil(F.col("n") / block).cast("int")).withColumn("b", F.pmod(F.xxhash64("id", "key"), F.col("parts")).cast("int"))
        cut = cut.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        return cut.select("key", "g", "w", "id", "b", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), *[c for c in placed.columns if c == "embedding"])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = None
        for batch in batches:
            m = _matrix(batch.column("embedding"))
            if not len(m):
                continue
            if planes is None:
                planes = np.random.default_rng(seed).standard_normal((m.shape[1], tables * bits))
            keys = ((m @ planes) > 0).reshape(len(m), tables, bits) @ (1 << np.arange(bits))
            keys = keys + (np.arange(tables) << bits)
            at = pa.array(np.repeat(np.arange(len(m)), tables))
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), batch.column("id").take(at), batch.column("w").take(at)], ["key", "id", "w"])

    def compare(group: pa.Table) -> pa.Table:
        i, j = group["i"][0].as_py(), group["j"][0].as_py()
        ids, b, w = (group[c].to_numpy() for c in ("id", "b", "w"))
        m, norm = _raw(group["embedding"].combine_chunks())
        found = [np.empty((2, 0), dtype=np.int64)]
        for each in np.unique(w):
            at = np.flatnonzero(w == each)
            x, y = _reaching(m, norm, at[b[at] == i], at[b[at] == j], min_cos)
            keep = ids[x] < ids[y] if i == j else ids[x] != ids[y]
            found.append(np.sort([ids[x[keep]], ids[y[keep]]], axis=0))
        u, v = np.hstack(found)
        return pa.table({"u": u, "v": v})

    met = None
    if (most or 0) > exact_to:
        bits, tables = plan or table_plan(most, min_cos, recall)
        keys = scratch.write(rows.join(own.filter("tabled").select("w"), "w", "left_semi").mapInArrow(sign, "key long, id long, w long"))
        sizes = keys.groupBy("key", "w").agg(F.count("*").alias("n")).filter("n > 1")
        if not plan:
            cost = sizes.groupBy("w").agg(F.sum(F.col("n") * (F.col("n") + COPY_COST).cast("double")).alias("cost"))
            own = scratch.write(own.join(cost, "w", "left").select("w", "n", (F.col("tabled") & (F.coalesce("cost", F.lit(0.0)) < F.col("n") * F.col("n").cast("double"))).alias("tabled")))
            sizes = sizes.join(own.filter("tabled").select("w"), "w", "left_semi")
        # Written vectors are small as files and large as rows, so a join by the size of files would send them all to the driver.
        met = spread(keys.join(sizes, ["key", "w"]).withColumn("g", F.col("w"))).join(rows.select("id", "embedding").hint("merge"), "id")
    shared = F.col("n") <= block
    whole = rows.join(own.filter("not tabled").drop("tabled"), "w").withColumn("key", F.when(shared, -2).otherwise(-1).cast("long"))
    whole = spread(whole.withColumn("g", F.when(shared, F.pmod("w", F.lit(cells))).otherwise(F.col("w"))))
    met = whole if met is None else whole.unionByName(met)
    return scratch.write(met.groupBy("key", "g", "i", "j").applyInArrow(compare, "u long, v long").distinct())


def _copies(rows: DataFrame, within: str | None, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(id, tag, embedding) of all rows, and one row (rep, w, tag, e, copies) for each different vector of a ``within``; zero vectors stand alone."""
    base = _keyed(rows, within).dropDuplicates(["id"])
    zero = ~F.exists("embedding", lambda x: x != 0)
    base = scratch.write(base.withColumn("tag", F.when(zero, F.xxhash64("w", "id")).otherwise(F.xxhash64("w", "embedding"))).withColumn("own", F.when(zero, F.col("id"))))
    reps = base.groupBy("tag", "w", "embedding", "own").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    return base, scratch.write(reps.select("rep", "w", "tag", F.col("embedding").alias("e"), "own", "copies"))


def near_classes(rows: DataFrame, min_cos: float, within: str | None = None, recall: float = 0.999, block: int = 2048, plan: tuple[int, int] | None = None) -> DataFrame:
    """(id, class_id, links) of every vector: its class under cosine >= min_cos, by the links of near_links(), and how many others it is linked to.

    Equal vectors are compared as one, however many they are; they count as linked to each other. The smallest id of a class names it.
    """
    scratch = Scratch(rows.sparkSession, "classes")
    base, reps = _copies(rows, within, scratch)
    links = near_links(reps.select(F.col("rep").alias("id"), F.col("e").alias("embedding"), "w"), min_cos, "w", recall, block, plan=plan)
    comp = connected_components(links, "u", "v").select(F.col("node").alias("rep"), F.col("component").alias("class_id"))
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    degree = both.join(reps.select(F.col("rep").alias("v"), "copies"), "v").groupBy(F.col("u").alias("rep")).agg(F.sum("copies").alias("others"))
    named = reps.join(comp, "rep", "left").join(degree, "rep", "left").select(
        "tag", F.col("e"), F.col("own").alias("o"), F.coalesce("class_id", "rep").alias("class_id"), (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).cast("long").alias("links"), F.col("copies").alias("cnt")
    )
    return lookup(base, scratch.write(named), "tag").filter("embedding = e and own <=> o").select("id", "class_id", "links")


def _reject_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rejected nodes of links u < v, decided from the smallest node on."""
    near: dict[int, list[int]] = {}
    for pdf in batches:
        for u, v in zip(pdf["u"].tolist(), pdf["v"].tolist()):
            near.setdefault(v, []).append(u)
    gone: set[int] = set()
    for v in sorted(near):
        if any(u not in gone for u in near[v]):
            gone.add(v)
    yield pd.DataFrame({"id": sorted(gone)}, dtype="int64")


def rejected_in_turn(links: DataFrame, few_links: int = FEW_EDGES) -> DataFrame:
    """(id) of the nodes that are turned away when nodes come in the order of their ids and each is taken unless linked to one taken before.

    links: (u, v), u < v. In rounds, nodes without an undecided smaller neighbour are taken and their larger neighbours turned away, by joins; when at most ``few_links``
    links are left, one task decides them. Nodes without links are taken.
    """
    scratch = Scratch(links.sparkSession, "turns")
    links, gone = scratch.write(links.select("u", "v").filter("u < v").distinct()), []
    while links.count() > few_links:
        taken = links.select("u").distinct().join(links.select(F.col("v").alias("u")).distinct(), "u", "left_anti")
        away = scratch.write(links.join(taken, "u", "left_semi").select(F.col("v").alias("id")).distinct())
        gone.append(away)
        left = links.join(away.withColumnRenamed("id", "v"), "v", "left_anti").join(away.withColumnRenamed("id", "u"), "u", "left_anti")
        links = scratch.write(left.join(taken, "u", "left_anti").select("u", "v"))
    out = links.coalesce(1).mapInPandas(_reject_batches, "id long")
    for more in gone:
        out = out.unionByName(more)
    return out


def accepted_in_turn(rows: DataFrame, max_cos: float, within: str | None = None) -> DataFrame:
    """(id, accepted) of rows (id, embedding[, within]) that come in the order of their ids: each is accepted unless its cosine with one accepted before is ``max_cos`` or more.

    Of equal vectors only the first can be. Rows without a vector are left out.
    """
    scratch = Scratch(rows.sparkSession, "accept")
    base, reps = _copies(rows, within, scratch)
    away = rejected_in_turn(near_links(reps.select(F.col("rep").alias("id"), F.col("e").alias("embedding"), "w"), max_cos, "w"))
    taken = reps.select(F.col("rep").alias("id")).join(away, "id", "left_anti").withColumn("accepted", F.lit(True))
    return base.select("id").join(taken, "id", "left").select("id", F.coalesce("accepted", F.lit(False)).alias("accepted"))
