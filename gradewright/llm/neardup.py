"""Problem 4: near-duplicate records, by covering locality-sensitive hashing."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradewright.llm.words import WordHashes, gram_hashes, hash_words, mix
from gradewright.scratch import Scratch
from gradewright.skew import lookup

#: (bit masks, largest bucket whose pairs are listed) of each covering; a later one serves the records that the one before can't cover.
COVERINGS = ((1024, 64), (8192, 512))
#: Members of a block of the last covering; two blocks meet in one task.
BLOCK = 512
#: Members of a bucket of the last covering up to which its pairs are listed; larger ones are compared in blocks.
FEW = 64
#: Words of 64 bits of a record's sketch.
SKETCH = 4


def _shingle_batches(n: int):
    """Emits each record's set of hashed runs of n words of [a-z0-9]+ in the lower-cased text, a digest of the set, and its sketch: the bits its members hash to."""
    find = re.compile(rb"[a-z0-9]+").findall

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in batches:
            out: dict[str, list] = {"scope": [], "id": [], "sh": [], "h": [], "sketch": []}
            for scope, key, text in zip(*(batch.column(c).to_pylist() for c in ("scope", "id", "text"))):
                words = find(text.lower().encode("utf-8", "replace"))
                if len(words) < n:
                    continue
                salt = np.uint64(xxhash.xxh3_64_intdigest(scope.encode()))
                runs = np.sort(np.unique(gram_hashes(hash_words(words, memo), n) ^ salt).view(np.int64))
                bits = np.zeros(SKETCH * 64, np.uint8)
                bits[(mix(runs.view(np.uint64)) >> np.uint64(40)).astype(np.int64) % (SKETCH * 64)] = 1
                for name, value in (("scope", scope), ("id", key), ("sh", runs), ("h", xxhash.xxh3_128_digest(runs.tobytes())), ("sketch", np.packbits(bits).view(np.int64))):
                    out[name].append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out["scope"], pa.string()), pa.array(out["id"], pa.int64()), pa.array(out["sh"], pa.list_(pa.int64())), pa.array(out["h"], pa.binary()), pa.array(out["sketch"], pa.list_(pa.int64()))],
                ["scope", "id", "sh", "h", "sketch"],
            )

    return run


def _mask_keys(blocks: int, keep: int, lose: int):
    """Emits, for each record and each of the bit masks, the hash of the bits that the mask leaves.

    A shingle is a bit position; mask b leaves the positions hashed to b. Masks that leave nothing emit nothing.
    ``blocks`` is how many masks leave something, ``need`` under how many of them a record must be found to be covered.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("sh")
            n = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            bits = mix(lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64) ^ np.uint64(blocks))
            row = np.repeat(np.arange(len(n)), n)
            place = row * blocks + (bits % np.uint64(blocks)).astype(np.int64)
            order = np.argsort(place, kind="stable")
            place, bits = place[order], mix(bits[order])
            if not len(place):
                continue
            first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
            total = np.add.reduceat(bits, first)
            place = place[first]
            row = place // blocks
            key = mix(total ^ mix((place % blocks).astype(np.uint64)))
            left = np.bincount(row, minlength=len(n))
            columns = (n, left, n * lose // keep + 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.view(np.int64)), pa.array(batch.column("rid").to_numpy()[row]), *[pa.array(c[row].astype(np.int32)) for c in columns]],
                ["key", "rid", "n", "blocks", "need"],
            )

    return run


def _block_pairs(num: int, den: int):
    """Compares the members of two blocks of one bucket and emits the pairs that are alike enough."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
        rid, block = pdf["rid"].to_numpy(), pdf["block"].to_numpy()
        sets = list(pdf["sh"])
        size = np.array([len(s) for s in sets])
        _, at = np.unique(np.concatenate(sets), return_inverse=True)
        grid = np.zeros((len(sets), at.max() + 1), dtype=np.float32)
        grid[np.repeat(np.arange(len(sets)), size), at] = 1
        a, b = np.flatnonzero(block == i), np.flatnonzero(block == j)
        inter = grid[a] @ grid[b].T
        union = size[a][:, None] + size[b][None, :] - inter
        x, y = np.nonzero(inter * den >= num * union)
        left, right = rid[a[x]], rid[b[y]]
        low, high = np.minimum(left, right), np.maximum(left, right)
        keep = low < high
        return pd.DataFrame({"a": low[keep], "b": high[keep]}).drop_duplicates()

    return run


class NearDuplicates:
    """The pairs of records of one scope whose word-shingle sets have a Jaccard similarity of num/den or more.

    records: (scope, id, text). Repeated (scope, id) count once, by the least text. Null texts and texts
    under n words have no shingles and no pairs. Records with equal shingle sets are one node of the search.

    A record is a bit vector over shingles. Similar sets A and B differ in at most r = |A| (den - num) / num
    bits. The masks of a covering split the bits, so at most r masks see a difference: if A leaves something under more
    than r masks, one of these leaves the same in B, and the two collide under it. So it is enough that each record is looked
    for under its r + 1 rarest keys, in an order that all records share: the first key two similar records have in common is then
    among those of both. Buckets above a bound are not listed; records that would need one (long, short or
    made of very common runs) get the next covering among themselves, with more masks and larger buckets, and the
    last of them one with a mask per bit, of which each record needs its r + 1 rarest; its large buckets are cut
    into blocks and compared block by block, so no task holds a whole bucket. Listed pairs whose sketches differ too much can't be similar
    and are dropped where they arise; every other one is then checked exactly.
    """

    def __init__(self, records: DataFrame, num: int = 3, den: int = 5, n: int = 3, coverings=COVERINGS, block: int = BLOCK, few: int = FEW):
        self.scratch = scratch = Scratch(records.sparkSession, "neardup")
        self.num, self.den = num, den
        rows = records.select("scope", F.col("id").cast("long").alias("id"), "text").dropna().groupBy("scope", "id").agg(F.min("text").alias("text"))
        sets = scratch.write(rows.mapInArrow(_shingle_batches(n), "scope string, id long, sh array<long>, h binary, sketch array<long>"))
        self.members = sets.select("scope", "id", "h")
        groups = sets.groupBy("scope", "h").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("sh").alias("sh"), F.first("sketch").alias("sketch"))
        self.reps = scratch.write(groups.select(F.monotonically_increasing_id().alias("rid"), "scope", "h", "id", "copies", "sh", "sketch"))
        left = self.reps.select("rid", "sh")
        found = []
        for blocks, bucket in coverings:
            pairs, left = self._cover(left, blocks, bucket)
            found.append(pairs)
            if left.isEmpty():
                break
        else:
            found.append(self._last(left, block, few))
        out = found[0]
        for pairs in found[1:]:
            out = out.unionByName(pairs)
        self.rep_pairs = scratch.write(out.distinct() if len(found) > 1 else out)

    def _cover(self, left: DataFrame, blocks: int, bucket: int) -> tuple[DataFrame, DataFrame]:
        keys = self.scratch.write(left.mapInArrow(_mask_keys(blocks, self.num, self.den - self.num), "key long, rid long, n int, blocks int, need int"))
        sizes = self.scratch.write(keys.groupBy("key").agg(F.count("*").alias("df")).filter("df > 1"))
        shared = lookup(keys, sizes.withColumn("cnt", F.col("df")), "key")
        # Keys of one record only come first in every record's order; they are counted but need not be looked under.
        own = Window.partitionBy("rid")
        place = F.row_number().over(own.orderBy("df", "key")) + F.col("blocks") - F.count("*").over(own)
        first = self.scratch.write(shared.withColumn("place", place).filter("place <= need").select("key", "rid", "n", "df"))
        checked = self._listed(first.filter(F.col("df") <= bucket))
        bare = first.filter(F.col("df") > bucket).select("rid").union(keys.filter("blocks < need").select("rid")).distinct()
        return checked, self.scratch.write(left.join(bare, "rid"))

    def _listed(self, rows: DataFrame) -> DataFrame:
        """(a, b): the similar pairs among the rows (key, rid, n) of each key, of which no key has many."""
        sketches = self.reps.select("rid", *[F.col("sketch")[i].alias(f"s{i}") for i in range(SKETCH)])
        listed = rows.join(sketches, "rid")
        bags = listed.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("rid", "n", *[f"s{i}" for i in range(SKETCH)]))).alias("bag"))
        listed_pairs = bags.select(F.posexplode("bag").alias("i", "x"), "bag").select("x", F.explode(F.expr("slice(bag, i + 2, size(bag))")).alias("y"))
        # A bit of one sketch that the other lacks is a member that the other lacks; a similar pair can't have many.
        lacks = [" + ".join(f"bit_count({p}.s{i} & ~{q}.s{i})" for i in range(SKETCH)) for p, q in (("x", "y"), ("y", "x"))]
        least = f"{self.num} * (x.n + y.n)"
        near = F.expr(f"{self.num + self.den} * (x.n - ({lacks[0]})) >= {least} AND {self.num + self.den} * (y.n - ({lacks[1]})) >= {least}")
        pairs = listed_pairs.filter(near).select(F.col("x.rid").alias("a"), F.col("y.rid").alias("b")).distinct()
        sets = self.reps.select("rid", "sh")
        return (
            pairs.join(sets.select(F.col("rid").alias("a"), F.col("sh").alias("sa")), "a")
            .join(sets.select(F.col("rid").alias("b"), F.col("sh").alias("sb")), "b")
            .withColumn("inter", F.size(F.array_intersect("sa", "sb")))
            .filter(F.col("inter") * self.den >= (F.size("sa") + F.size("sb") - F.col("inter")) * self.num)
            .select("a", "b")
        )

    def _last(self, left: DataFrame, block: int, few: int) -> DataFrame:
        bits = self.scratch.write(left.select("rid", F.size("sh").alias("n"), F.explode("sh").alias("key")))
        df = bits.groupBy("key").agg(F.count("*").alias("cnt"))
        df = self.scratch.write(df.filter("cnt > 1"))
        ranked = lookup(bits, df.select("key", F.col("cnt").alias("df"), "cnt"), "key")
        # Bits that no other record here has come first in the order; they need not be looked at, but they count.
        alone = bits.join(df, "key", "left_anti").groupBy("rid").agg(F.count("*").alias("alone"))
        need = F.floor(F.col("n") * (self.den - self.num) / self.num) + 1 - F.coalesce("alone", F.lit(0))
        order = Window.partitionBy("rid").orderBy("df", "key")
        prefix = self.scratch.write(ranked.join(alone, "rid", "left").withColumn("pos", F.row_number().over(order)).filter(F.col("pos") <= need).select("key", "rid", "n", "df"))
        listed = self._listed(prefix.filter(F.col("df") <= few).select("key", "rid", F.col("n").cast("int").alias("n")))
        parts = F.ceil(F.col("df") / block).cast("int")
        placed = prefix.filter(F.col("df") > few).select("key", "rid", parts.alias("parts"), F.pmod(F.xxhash64("rid", "key"), parts).cast("int").alias("block"))
        spread = placed.select("key", "rid", "block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
        met = spread.join(left, "rid").select("key", "rid", "block", "sh", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
        return listed.unionByName(met.groupBy("key", "i", "j").applyInPandas(_block_pairs(self.num, self.den), "a long, b long")).distinct()

    def groups(self) -> DataFrame:
        """(scope, id, group_id, links) of every record with shingles: its group, and the number of other texts it is near to."""
        from gradewright.llm.consolidate import consolidate

        comp = consolidate(self.rep_pairs).withColumnsRenamed({"node": "rid", "group_id": "g"})
        both = self.rep_pairs.union(self.rep_pairs.select("b", "a"))
        degree = both.groupBy("a").agg(F.count("*").alias("links")).withColumnRenamed("a", "rid")
        placed = self.reps.select("rid", "scope", "h", "id", "copies").join(comp, "rid", "left").join(degree, "rid", "left").withColumn("g", F.coalesce("g", "rid"))
        low = placed.groupBy("g").agg(F.min("id").alias("group_id"))
        named = placed.join(low, "g").select("h", F.col("scope").alias("s"), "group_id", F.coalesce("links", F.lit(0).cast("long")).alias("links"), F.col("copies").alias("cnt"))
        return lookup(self.members, self.scratch.write(named), "h").filter("s = scope").select("scope", "id", "group_id", "links")

    def pairs(self, block: int = BLOCK) -> DataFrame:
        """(scope, id_a, id_b), id_a < id_b: all similar pairs, records with equal shingle sets included, whatever their number.

        Members of such a group are cut into blocks, and blocks meet in pairs, so no row holds a whole group.
        """
        alone = self.reps.filter("copies = 1").select("rid", F.lit(0).alias("block"), F.array("id").alias("ids"))
        many = self.reps.filter("copies > 1").select("rid", "h", F.col("scope").alias("s"), "copies", F.col("copies").alias("cnt"))
        parts = F.ceil(F.col("copies") / block)
        placed = lookup(self.members, many, "h").filter("s = scope").withColumn("block", F.pmod(F.xxhash64("id"), parts).cast("int"))
        own = self.scratch.write(placed.groupBy("rid", "block").agg(F.collect_list("id").alias("ids")))
        wide = alone.unionByName(own)
        left = wide.select(F.col("rid").alias("a"), F.col("ids").alias("xs"))
        right = wide.select(F.col("rid").alias("b"), F.col("ids").alias("ys"))
        across = self.rep_pairs.join(left, "a").join(right, "b").select(F.col("a").alias("rid"), "xs", "ys")
        within = own.select("rid", F.col("block").alias("i"), F.col("ids").alias("xs")).join(own.select("rid", F.col("block").alias("j"), F.col("ids").alias("ys")), "rid").filter("i <= j")
        met = across.unionByName(within.filter("i < j").select("rid", "xs", "ys")).withColumn("same", F.lit(False)).unionByName(within.filter("i = j").select("rid", "xs", "ys").withColumn("same", F.lit(True)))
        out = met.select("rid", "same", F.explode("xs").alias("x"), "ys").select("rid", "same", "x", F.explode("ys").alias("y")).filter("not same or x < y")
        named = out.join(self.reps.select("rid", "scope"), "rid")
        return named.select("scope", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
