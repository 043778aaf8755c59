"""Problem 1: long exact spans shared between records, by De Bruijn compaction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradewright.llm.words import WordHashes, gram_hashes, hash_words, sliding_min
from gradewright.scratch import Scratch
from gradewright.skew import lookup

MIN_WORDS = 25


def _split(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split()


def _signed(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64))


def _anchor_batches(k: int, m: int):
    """Emits the anchors of each record: the least m-gram hash of every window of k words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in batches:
            rids, out, n = batch.column("rid").to_pylist(), [], []
            for text in batch.column("text"):
                grams = gram_hashes(hash_words(_split(text.as_py()), memo), m)
                own = np.unique(sliding_min(grams, k - m + 1)) if len(grams) > k - m else grams[:0]
                out.append(own)
                n.append(len(own))
            if sum(n):
                yield pa.RecordBatch.from_arrays([_signed(np.concatenate(out)), pa.array(np.repeat(np.array(rids), n))], ["anchor", "rid"])

    return run


def _kmer_batches(k: int, m: int):
    """Emits the k-mers whose anchor stands in several records, with the words before and after."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in batches:
            rids = batch.column("rid").to_pylist()
            parts: list[list[np.ndarray]] = [[], [], [], [], []]
            for rid, text, anchors in zip(rids, batch.column("text"), batch.column("anchors")):
                w = hash_words(_split(text.as_py()), memo)
                least = sliding_min(gram_hashes(w, m), k - m + 1)
                at = np.flatnonzero(np.isin(least, np.asarray(anchors.values).view(np.uint64)))
                if not len(at):
                    continue
                kh = gram_hashes(w, k)[at]
                # 0 stands for "no word": the record begins or ends here.
                edged = np.concatenate([np.zeros(1, np.uint64), w | np.uint64(1), np.zeros(1, np.uint64)])
                for part, value in zip(parts, (kh, at.astype(np.uint64), edged[at], edged[at + k + 1], np.full(len(at), rid, np.int64).view(np.uint64))):
                    part.append(value)
            if parts[0]:
                yield pa.RecordBatch.from_arrays([_signed(np.concatenate(p)) for p in parts], ["kh", "pos", "before", "after", "rid"])

    return run


def _digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads the words at the coordinates of each segment and emits a 128-bit digest of them."""
    for batch in batches:
        out: dict[str, list] = {"rid": [], "seg": [], "first_word": [], "last_word": [], "digest": []}
        for rid, text, segs in zip(batch.column("rid").to_pylist(), batch.column("text"), batch.column("segs")):
            words = _split(text.as_py())
            for s in segs.as_py():
                a, b = s["first_word"], s["last_word"]
                for name, value in (("rid", rid), ("seg", s["seg"]), ("first_word", a), ("last_word", b), ("digest", xxhash.xxh3_128_digest(b" ".join(words[a:b + 1])))):
                    out[name].append(value)
        yield pa.RecordBatch.from_pydict(
            out, schema=pa.schema([("rid", pa.int64()), ("seg", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("digest", pa.binary())])
        )


class SharedSpans:
    """The shared passages of a set of records and where they stand.

    records: (rec_table, rec_id, text), one row a record; a repeated (rec_table, rec_id) counts once, by the
    least text. Null and empty texts share nothing. Words are what blanks and line breaks separate.

    Steps: (1) records with the same text are one node of the search, and share all of it. (2) Every
    window of k words has an anchor, its least m-gram; equal windows have equal anchors, so only windows whose anchor stands in
    several records can be shared. (3) Their k-mers are the edges of a De Bruijn graph over (k-1)-word nodes;
    an edge is repeated if several records have it, and one aggregate tells whether its ends branch.
    (4) Joined back to the records, repeated edges in a row compact into one segment until a branching
    node. (5) The words at each segment's coordinates are read from the source and compared by 128-bit digests;
    only segments that two records really have stay. (6) Segments of a record that touch or overlap form its
    stretches. Anchors or edges of a third of all records are split off by lookup(); no record pairs are made.
    """

    def __init__(self, records: DataFrame, min_words: int = MIN_WORDS, anchor_words: int | None = None):
        k, m = min_words, anchor_words or (min_words + 1) // 2
        scratch = Scratch(records.sparkSession, "spans")
        rows = (
            records.select("rec_table", F.col("rec_id").cast("long").alias("rec_id"), "text")
            .filter(F.col("text").isNotNull()).groupBy("rec_table", "rec_id").agg(F.min("text").alias("text"))
        )
        self.members = scratch.write(rows.select("rec_table", "rec_id", F.sha2("text", 256).alias("h"), "text"))
        groups = self.members.groupBy("h").agg(F.count("*").alias("copies"), F.min("text").alias("text"))
        words = F.size(F.filter(F.split("text", r"[ \t\n\x0B\f\r]+"), lambda x: x != ""))
        self.texts = scratch.write(groups.select(F.monotonically_increasing_id().alias("rid"), "h", "copies", words.cast("long").alias("n_words"), "text"))
        long_enough = self.texts.filter(F.col("n_words") >= k).select("rid", "text")

        seeds = scratch.write(long_enough.mapInArrow(_anchor_batches(k, m), "anchor long, rid long"))
        several = seeds.groupBy("anchor").agg(F.min("rid").alias("lo"), F.max("rid").alias("hi"), F.count("*").alias("cnt")).filter("lo < hi")
        several = scratch.write(several.select("anchor", "cnt"))
        marked = lookup(seeds, several, "anchor").groupBy("rid").agg(F.collect_set("anchor").alias("anchors"))
        kmers = scratch.write(
            long_enough.join(marked, "rid").mapInArrow(_kmer_batches(k, m), "kh long, pos long, before long, after long, rid long")
        )

        one = lambda c: (F.min(c) == F.max(c)) & (F.min(c) != 0)
        edges = kmers.groupBy("kh").agg(
            F.min("rid").alias("lo"), F.max("rid").alias("hi"), F.count("*").alias("cnt"),
            (~one("before")).alias("opens"), (~one("after")).alias("closes"),
        ).filter("lo < hi")
        edges = scratch.write(edges.select("kh", "cnt", "opens", "closes"))
        found = lookup(kmers.select("kh", "pos", "rid"), edges, "kh")
        order = Window.partitionBy("rid").orderBy("pos")
        new = (
            F.col("opens") | F.coalesce(F.lag("closes").over(order), F.lit(True)) | (F.col("pos") != F.coalesce(F.lag("pos").over(order), F.lit(-2)) + 1)
        )
        segments = (
            found.withColumn("new", new.cast("long")).withColumn("no", F.sum("new").over(order))
            .groupBy("rid", "no")
            .agg(F.min_by("kh", "pos").alias("seg"), F.min("pos").alias("first_word"), (F.max("pos") + k - 1).alias("last_word"))
        )
        per_record = segments.groupBy("rid").agg(F.collect_list(F.struct("seg", "first_word", "last_word")).alias("segs"))
        self.read = scratch.write(
            self.texts.select("rid", "text").join(per_record, "rid")
            .mapInArrow(_digest_batches, "rid long, seg long, first_word long, last_word long, digest binary")
        )
        verified = self.read.groupBy("digest").agg(F.min("rid").alias("lo"), F.max("rid").alias("hi"), F.count("*").alias("cnt"), F.count_distinct("rid").alias("n_texts")).filter("lo < hi")
        self.verified = scratch.write(verified.select("digest", "cnt", "n_texts"))
        self._k = k

    def stretches(self) -> DataFrame:
        """(rec_table, rec_id, first_word, last_word): the maximal shared stretches of every record."""
        parts = lookup(self.read, self.verified.select("digest", "cnt"), "digest").select("rid", "first_word", "last_word")
        order = Window.partitionBy("rid").orderBy("first_word", "last_word")
        reach = F.max("last_word").over(order.rowsBetween(Window.unboundedPreceding, -1))
        merged = (
            parts.withColumn("new", F.coalesce(F.col("first_word") > reach + 1, F.lit(True)).cast("long"))
            .withColumn("no", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
            .groupBy("rid", "no").agg(F.min("first_word").alias("first_word"), F.max("last_word").alias("last_word"))
        )
        texts = self.texts.select("rid", "h", "copies", "n_words")
        single = merged.join(texts.filter("copies = 1"), "rid").select("h", "first_word", "last_word")
        whole = texts.filter((F.col("copies") > 1) & (F.col("n_words") >= self._k)).select(
            "h", F.lit(0).cast("long").alias("first_word"), (F.col("n_words") - 1).alias("last_word")
        )
        members = self.members.select("rec_table", "rec_id", "h")
        copied = lookup(members, whole.join(texts.select("h", F.col("copies").alias("cnt")), "h"), "h")
        return copied.unionByName(members.join(single, "h")).select("rec_table", "rec_id", "first_word", "last_word")

    def share(self) -> DataFrame:
        """(rec_table, rec_id, n_words, shared_words, share) of every record with a text; share is null without words."""
        own = self.stretches().groupBy("rec_table", "rec_id").agg(F.sum(F.col("last_word") - F.col("first_word") + 1).alias("shared_words"))
        sized = lookup(self.members.select("rec_table", "rec_id", "h"), self.texts.select("h", "n_words", F.col("copies").alias("cnt")), "h")
        return sized.join(own, ["rec_table", "rec_id"], "left").select(
            "rec_table", "rec_id", "n_words", F.coalesce("shared_words", F.lit(0).cast("long")).alias("shared_words"),
            F.expr("try_divide(coalesce(shared_words, 0), n_words)").cast("double").alias("share"),
        )

    def passages(self) -> DataFrame:
        """(passage, n_texts, n_places, n_words): every compacted passage, as digest, and how widely it stands."""
        sized = self.read.groupBy("digest").agg(F.first(F.col("last_word") - F.col("first_word") + 1).alias("n_words"))
        return self.verified.join(sized, "digest").select(F.hex("digest").alias("passage"), "n_texts", F.col("cnt").alias("n_places"), "n_words")
