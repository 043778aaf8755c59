"""Problem 8: fixed-capacity containers filled with documents, by best-two-fit."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradewright.scratch import Scratch

CAPACITY = 2048
#: Items that one task packs; each packing group leaves at most about one container unfilled.
ITEMS_PER_GROUP = 50_000
#: A ranks file of a public tokenizer, and its published splitting pattern (a fixed value).
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _count_batches(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(SparkFiles.get(name)).encode_ordinary
        for batch in batches:
            n = [len(encode(t.as_py())) if t.is_valid else 0 for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64())], ["doc_id", "n_tokens"])

    return run


def count_tokens(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, n_tokens) of every row, by the tokenizer's ranks file, which Spark brings to the executors; null and empty texts have 0."""
    documents.sparkSession.sparkContext.addFile(tokenizer)
    return documents.select("doc_id", "text").mapInArrow(_count_batches(os.path.basename(tokenizer)), "doc_id long, n_tokens long")


def best_two_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container number of each item; sizes are 1 to capacity.

    A container takes the largest unpacked item that fits until none does. While it has a gap, its smallest item
    is given back if two unpacked items together fit the gap so widened more tightly; the tightest such
    two are taken. Items of one size are interchangeable, so all searches run over counts by size.
    """
    order = np.argsort(sizes, kind="stable")
    count = np.bincount(sizes, minlength=capacity + 1)
    shelf = np.concatenate([[0], np.cumsum(count)])  # where each size begins in order
    taken = np.zeros(capacity + 1, dtype=np.int64)
    where = np.empty(len(sizes), dtype=np.int64)
    largest = np.where(count > 0, np.arange(capacity + 1), 0)
    largest = np.maximum.accumulate(largest)  # largest size present up to s
    left, bin_no = len(sizes), 0
    pile: list[list[int]] = []

    def fits(gap: int) -> int:
        s = int(largest[gap])
        while s and not count[s]:
            s = int(largest[s - 1])
        largest[gap] = s
        return s

    while left:
        own: list[int] = []
        gap = capacity
        while gap and (s := fits(gap)):
            own.append(s)
            count[s] -= 1
            gap -= s
            left -= 1
        while gap and left > 1 and own:
            low = min(own)
            wide = gap + low
            for total in range(min(wide, 2 * capacity), low, -1):
                a = np.arange(max(1, total - capacity), total // 2 + 1)
                pair = (count[a] > 0) & (count[total - a] > 0)
                if total % 2 == 0 and len(a) and a[-1] * 2 == total and count[a[-1]] < 2:
                    pair[-1] = False
                hit = np.flatnonzero(pair)
                if len(hit):
                    break
            else:
                break
            x = int(a[hit[-1]])
            y = total - x
            own.remove(low)
            own += [x, y]
            count[x] -= 1
            count[y] -= 1
            count[low] += 1
            largest[low:] = np.maximum(largest[low:], low)
            left -= 1
            gap = wide - total
            while gap and (s := fits(gap)):
                own.append(s)
                count[s] -= 1
                gap -= s
                left -= 1
        pile.append(own)
        bin_no += 1
    for no, own in enumerate(pile):
        for s in own:
            where[order[shelf[s] + taken[s]]] = no
            taken[s] += 1
    return where


def _pack_group(capacity: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("piece_no", "ascending")])
        sizes = table.column("n_tokens").to_numpy().astype(np.int64)
        bins = best_two_fit(sizes, capacity)
        group = table.column("g")[0].as_py()
        ids = pa.array(group * (1 << 32) + bins, pa.int64())
        return pa.table({"container_id": ids, **{c: table.column(c) for c in ("doc_id", "piece_no", "first_token", "n_tokens")}})

    return run


def pack(sizes: DataFrame, capacity: int = CAPACITY, items_per_group: int = ITEMS_PER_GROUP) -> DataFrame:
    """(container_id, doc_id, piece_no, first_token, n_tokens): every document's container.

    sizes: (doc_id, n_tokens). Only documents above the capacity are split, into full containers and a rest that is packed like a
    document. Documents without tokens (null or empty) come out with a null container. A repeated doc_id counts once, by its
    largest size; null ids are left out. Items are spread by hash over groups of about ``items_per_group`` that are packed apart from
    each other: no group depends on a key, so none can grow hot, and waste is about one container per group.
    """
    scratch = Scratch(sizes.sparkSession, "packing")
    docs = scratch.write(sizes.filter("doc_id is not null").groupBy("doc_id").agg(F.max("n_tokens").alias("n")))
    full = F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / capacity))
    items = docs.filter("n > 0").select("doc_id", "n", F.explode(full).alias("piece_no")).select(
        "doc_id", F.col("piece_no").cast("int").alias("piece_no"), (F.col("piece_no") * capacity).alias("first_token"),
        F.least(F.lit(capacity), F.col("n") - F.col("piece_no") * capacity).cast("long").alias("n_tokens"),
    )
    n = docs.agg(F.sum(F.ceil(F.col("n") / capacity))).first()[0] or 0
    groups = max(1, -(-n // items_per_group))
    packed = items.withColumn("g", F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(groups))).groupBy("g").applyInArrow(
        _pack_group(capacity), "container_id long, doc_id long, piece_no int, first_token long, n_tokens long"
    )
    none = docs.filter("n = 0").select(
        F.lit(None).cast("long").alias("container_id"), "doc_id", F.lit(0).alias("piece_no"), F.lit(0).cast("long").alias("first_token"), F.lit(0).cast("long").alias("n_tokens")
    )
    return packed.unionByName(none)
