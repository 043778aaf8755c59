"""Problem 9: evaluation items leaking into documents, by rare seeds and local alignment."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradewright.llm.words import gram_hashes
from gradewright.scratch import Scratch

#: Words of a verbatim run that counts as a leak, and of a seed.
RUN, SEED = 12, 5
#: Share of an item's words whose score, 2 a word, an edited copy must reach.
SHARE = 0.6
#: Words of the items handled at a time; more items are handled in blocks, each against all documents.
BLOCK_WORDS = 200_000

_find = re.compile(rb"[a-z0-9]+").findall


def _words(text: str) -> list[bytes]:
    return _find(text.lower().encode("utf-8", "replace"))


class _Items:
    """A block of items as numbers: a vocabulary, the items' words, and where each seed stands."""

    def __init__(self, rows: list[tuple[int, str]], seed: int):
        self.vocabulary: dict[bytes, int] = {}
        self.words: dict[int, np.ndarray] = {}
        for key, text in rows:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in _words(text)]
            if len(ids) >= seed:
                self.words[key] = np.array(ids, dtype=np.int64)
        self.seed = seed
        self.grams = {k: gram_hashes(w.astype(np.uint64) + np.uint64(1), seed) for k, w in self.words.items()}
        self.known = np.unique(np.concatenate(list(self.grams.values()))) if self.grams else np.empty(0, np.uint64)
        self.keys = sorted(self.words)
        bags = [np.unique(self.words[k], return_counts=True) for k in self.keys]
        self.bag_first = np.concatenate([[0], np.cumsum([len(w) for w, _ in bags])]).astype(np.int64)
        self.bag_word = np.concatenate([w for w, _ in bags]) if bags else np.empty(0, np.int64)
        self.bag_n = np.concatenate([n for _, n in bags]) if bags else np.empty(0, np.int64)
        self.sizes = np.array([len(self.words[k]) for k in self.keys], np.int64)

    def number(self, words: list[bytes]) -> np.ndarray:
        get = self.vocabulary.get
        return np.fromiter((get(w, -1) for w in words), dtype=np.int64, count=len(words))

    def common(self, ids: np.ndarray, which: np.ndarray) -> np.ndarray:
        """For each of the items, how many of its words, each as often as it stands there, are among ids."""
        count = np.bincount(ids[ids >= 0], minlength=len(self.vocabulary))
        many = self.bag_first[which + 1] - self.bag_first[which]
        ends = np.cumsum(many)
        at = np.repeat(self.bag_first[which] - (ends - many), many) + np.arange(many.sum())
        return np.add.reduceat(np.minimum(count[self.bag_word[at]], self.bag_n[at]), ends - many)

    def hits(self, ids: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ids, and the hashes, of the runs that are in ``among`` (sorted)."""
        if len(ids) < self.seed or not len(among):
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        gap = np.concatenate([[0], np.cumsum(ids < 0)])
        whole = np.flatnonzero(gap[self.seed:] == gap[:-self.seed])
        if not len(whole):
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        h = gram_hashes((ids + 1).astype(np.uint64), self.seed)[whole]
        at = np.minimum(np.searchsorted(among, h), len(among) - 1)
        ok = among[at] == h
        return whole[ok], h[ok]


def _frequency_batches(items: _Items):
    """Emits, for each known seed, in how many documents of the partition it stands; under null, how many documents there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, docs = np.zeros(len(items.known), dtype=np.int64), 0
        for batch in batches:
            docs += batch.num_rows
            for text in batch.column("text"):
                _, h = items.hits(items.number(_words(text.as_py())), items.known)
                if len(h):
                    counts[np.searchsorted(items.known, np.unique(h))] += 1
        at = np.flatnonzero(counts)
        seeds = pa.array([*items.known[at].view(np.int64).tolist(), None], pa.int64())
        yield pa.RecordBatch.from_arrays([seeds, pa.array([*counts[at].tolist(), docs], pa.int64())], ["seed", "n"])

    return run


def rare_seeds(items: _Items, frequency: dict[int | None, int], run: int) -> dict[int, list[tuple[int, int]]]:
    """Seed hash to (item, position): the rarest seed of every window of ``run`` words all of whose seeds stand in documents.

    A document with the whole window has its rarest seed, and no document has a window of which a seed stands nowhere.
    """
    out: dict[int, list[tuple[int, int]]] = defaultdict(list)
    none = 1 << 62
    width = run - items.seed + 1
    for key, grams in items.grams.items():
        df = np.array([frequency.get(int(g), none) for g in grams.view(np.int64)])
        for at in {a + int(np.argmin(df[a:a + width])) for a in range(len(grams) - width + 1) if df[a:a + width].max() < none}:
            out[int(grams[at])].append((key, at))
    return dict(out)


#: An alignment's score and its matched words in one number, so that the best score with the most matches wins.
_UNIT = 1 << 24


def align(passage: np.ndarray, item: np.ndarray) -> tuple[int, int, int]:
    """(score, matched words, longest verbatim run) of the Smith-Waterman alignment, +2 a match, -1 a mismatch or gap.

    Rows are vectorised; gaps along a row are a running maximum. Of the alignments of the best score the one with the most matched
    words counts.
    """
    n = len(item)
    steps = np.arange(n + 1) * _UNIT
    row = np.zeros(n + 1, dtype=np.int64)
    runs = np.zeros(n + 1, dtype=np.int64)
    best = longest = 0
    known = np.isin(passage, item)
    for w, is_known in zip(passage.tolist(), known.tolist()):
        fresh = np.empty(n + 1, dtype=np.int64)
        fresh[0] = 0
        if is_known:
            same = item == w
            np.maximum(row[:-1] + np.where(same, 2 * _UNIT + 1, -_UNIT), row[1:] - _UNIT, out=fresh[1:])
            runs[1:] = (runs[:-1] + 1) * same
            longest = max(longest, int(runs.max()))
        else:
            np.maximum(row[:-1], row[1:], out=fresh[1:])
            fresh[1:] -= _UNIT
            runs[:] = 0
        np.maximum(fresh, 0, out=fresh)
        row = np.maximum(np.maximum.accumulate(fresh + steps) - steps, 0)
        best = max(best, int(row.max()))
    return best // _UNIT, best % _UNIT, longest


def _leak_batches(items: _Items, seeds: dict[int, list[tuple[int, int]]], run_words: int, share: float, edited: bool):
    among = np.array(sorted(seeds), dtype=np.uint64)
    number = {k: j for j, k in enumerate(items.keys)}
    places = [x for g in among.tolist() for x in seeds[g]]
    first = np.concatenate([[0], np.cumsum([len(seeds[g]) for g in among.tolist()])]).astype(np.int64)
    owner, place = np.array([number[k] for k, _ in places], np.int64), np.array([p for _, p in places], np.int64)
    need = np.ceil(share * items.sizes - 1e-9).astype(np.int64)

    def candidates(ids: np.ndarray) -> Iterator[tuple[int, np.ndarray, bool]]:
        """(item, where in ids it would begin, whether a verbatim run is possible) of the items whose seeds stand in ids."""
        at, h = items.hits(ids, among)
        if not len(at):
            return
        g = np.searchsorted(among, h)
        many = first[g + 1] - first[g]
        entry = np.repeat(first[g] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        found_in, starts = owner[entry], np.repeat(at, many) - place[entry]
        order = np.lexsort((starts, found_in))
        found_in, starts = found_in[order], starts[order]
        # With all seeds, a verbatim run has each of its own on one diagonal.
        heads = np.flatnonzero(np.concatenate([[True], (found_in[1:] != found_in[:-1]) | (starts[1:] != starts[:-1])]))
        hits = np.diff(np.append(heads, len(starts)))
        found_in, starts = found_in[heads], starts[heads]
        cuts = np.flatnonzero(np.concatenate([[True], found_in[1:] != found_in[:-1]]))
        which = found_in[cuts]
        verbatim = np.maximum.reduceat(hits, cuts) > run_words - items.seed if edited else np.ones(len(which), bool)
        keep = verbatim | (items.common(ids, which) >= need[which])
        bounds = np.append(cuts, len(starts))
        for j in np.flatnonzero(keep).tolist():
            yield int(which[j]), starts[bounds[j]:bounds[j + 1]], bool(verbatim[j])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids = items.number(_words(text.as_py()))
                for which, begins, verbatim in candidates(ids):
                    own = items.words[items.keys[which]]
                    n, found = len(own), (0, 0, 0)
                    spans: list[list[int]] = []
                    for b in begins.tolist():
                        a, z = max(0, b - n // 4), min(len(ids), b + n + n // 4)
                        if spans and a <= spans[-1][1]:
                            spans[-1][1] = z
                        else:
                            spans.append([a, z])
                    # An alignment matches no more words than passage and item have in common.
                    for a, z in spans:
                        if verbatim or items.common(ids[a:z], np.array([which]))[0] >= need[which]:
                            found = tuple(map(max, found, align(ids[a:z], own)))
                    if found[2] >= run_words or found[0] >= 2 * need[which]:
                        out.append((key, items.keys[which], *found, found[1] / n))
            if out:
                names = ["doc_id", "item_id", "score", "matched", "longest_run", "share"]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names)

    return run


def _blocks(items: DataFrame, words: int) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of at most so many words; the driver holds one block."""
    rows = items.select(F.col("item_id").cast("long"), "text").dropna().groupBy("item_id").agg(F.min("text").alias("text")).orderBy("item_id").toLocalIterator()
    block, size = [], 0
    for key, text in rows:
        n = len(_words(text))
        if size and size + n > words:
            yield block
            block, size = [], 0
        block.append((key, text))
        size += n
    yield block


def leaks(documents: DataFrame, items: DataFrame, run: int = RUN, seed: int = SEED, share: float = SHARE, block_words: int = BLOCK_WORDS, edited: bool = True) -> DataFrame:
    """(doc_id, item_id, score, matched, longest_run, share): documents that give an item away, whole, in part or edited.

    documents (doc_id, text), items (item_id, text). Words are runs of a-z and 0-9 of the lower-cased text.
    Seeds are runs of ``seed`` words of an item. With ``edited``, all of them are looked for, however common, as an edited copy may keep any; without, a first pass
    counts in how many documents each stands, and only the rarest of every window of ``run`` item words is. Where a seed stands, the passage around
    it is aligned with the item, unless passage and item have too few words in common. A row is a verbatim run of ``run`` words, which
    neither choice can miss, or, with ``edited``, an alignment that scores as much as ``share`` of the item's words without an edit would, and keeps
    ``seed`` words in a row somewhere; without, such rows may be missing. Nothing of the documents is shuffled: the items, a stated query set, go to the
    documents, in blocks of at most ``block_words`` words, so what is sent out, and what the driver holds, is bounded. Every block is a pass
    over the documents (two without ``edited``).

    Null or empty texts have no leaks; items under ``seed`` words are left out; repeated rows of an item count
    once; a repeated doc_id gives one row per item, of its best values.
    """
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").dropna()
    blocks = _blocks(items, block_words)
    block, parts, scratch = next(blocks), [], None
    while block is not None:
        own = _Items(block, seed)
        after = next(blocks, None)
        if edited:
            seeds: dict[int, list[tuple[int, int]]] = defaultdict(list)
            for key, grams in own.grams.items():
                for at, g in enumerate(grams.tolist()):
                    seeds[g].append((key, at))
        else:
            counted = texts.select("text").mapInArrow(_frequency_batches(own), "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n"))
            seeds = rare_seeds(own, {r["seed"]: r["n"] for r in counted.toLocalIterator()}, run)  # at most one row a seed of the block
        part = texts.mapInArrow(
            _leak_batches(own, dict(seeds), run, share, edited), "doc_id long, item_id long, score long, matched long, longest_run long, share double"
        )
        if after is not None or parts:  # a block's result is written before the next block is read
            scratch = scratch or Scratch(documents.sparkSession, "leaks")
            part = scratch.write(part)
        parts.append(part)
        block = after
    out = reduce(DataFrame.unionByName, parts)
    return out.groupBy("doc_id", "item_id").agg(*[F.max(c).alias(c) for c in ("score", "matched", "longest_run", "share")])
