"""Problem 3: oversized texts split at natural boundaries, by packing a structure tree."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 1400, 135
#: A piece under this share of the budget is evened out with its neighbour.
SMALL = 0.25

# A token: a run of Unicode letters, digits and underscores, or any other single character that is not white space.
_TOKEN = re.compile(r"\w+|[^\w\s]")
_LINE = re.compile(r"[^\n]*\n?")
_LIST = re.compile(r"\s*(?:[-*•–]|\(?[0-9a-zA-Z]{1,3}[.)])\s+\S")
_HEADING = re.compile(r"\s*(?:#{1,6}\s+\S|\d+(?:\.\d+)*\.?\s+[A-Z][^.!?]*$|(?:[A-Z][\w'-]*|of|for|and|in|the|to|a|an)(?:\s+(?:[A-Z][\w'-]*|of|for|and|in|the|to|a|an)){0,9}\s*$)")
_SENTENCE = re.compile(r"(?<=[.!?])[\"')\]]*\s+|(?<=[。！？])")
_CLAUSE = re.compile(r"(?<=[,;:])\s+")


def _kind(line: str) -> str:
    if not line.strip():
        return "blank"
    if " | " in line:
        return "table"
    if _LIST.match(line):
        return "list"
    return "heading" if len(line) < 100 and _HEADING.match(line.rstrip("\n")) else "prose"


def _depth(heading: str) -> int:
    """How deep a heading lies: by its marks (##), by its number (1.2), else below the first two."""
    marks = re.match(r"\s*(?:(#{1,6})\s|(\d+(?:\.\d+)*)\.?\s)", heading)
    if marks is None:
        return 3
    return len(marks.group(1)) if marks.group(1) else marks.group(2).count(".") + 1


def _boundaries(text: str, starts: np.ndarray) -> list[np.ndarray]:
    """Offsets where the tree's levels begin: sections by the depth of their headings, blocks, outer lines, lines, sentences, clauses, tokens.

    Outer lines are all but list items set further in than the first item of their list. Every level has the boundaries of those above it.
    """
    sections: dict[int, list[int]] = {}
    blocks, outer, lines = [], [], []
    before, ended, margin = "blank", True, 0
    for m in _LINE.finditer(text):
        if m.start() == m.end():
            break
        line, kind = m.group(), _kind(m.group())
        if kind == "heading" and before != "heading":
            sections.setdefault(_depth(line), []).append(m.start())
        if kind != "blank" and (before == "blank" or (kind != before and "heading" != before)):
            blocks.append(m.start())
        indent = len(line) - len(line.lstrip())
        if kind == "list" and before != "list":
            margin = indent
        if kind != "blank" and (ended or kind in ("table", "list", "heading") or before != kind):
            (lines if kind == "list" and indent > margin else outer).append(m.start())
        if kind != "blank":
            ended = line.rstrip()[-1:] in ".!?:;"
        before = kind
    sentences = [m.end() for m in _SENTENCE.finditer(text)]
    clauses = [m.end() for m in _CLAUSE.finditer(text)]
    levels: list[np.ndarray] = []
    for own in (*(sections[d] for d in sorted(sections)), blocks, outer, lines, sentences, clauses, starts):
        levels.append(np.unique(np.concatenate([levels[-1] if levels else np.empty(0, np.int64), np.array(own, dtype=np.int64)])))
    return levels


def split_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """(overlap start, start, end) offsets of the pieces; [] if the text is within the limit.

    The stretches [start, end) tile the text. A span within the budget (the limit less the overlap) is a leaf;
    only a span above it is opened into the children of the next level, and neighbouring leaves are merged
    bottom-up while they fit; a small piece left beside a large one is evened out with it. Each later piece begins early, at the earliest sentence, line or block of its predecessor that
    lies within ``overlap`` tokens of the cut; failing one, at a token.
    """
    starts = np.fromiter((m.start() for m in _TOKEN.finditer(text)), dtype=np.int64)
    if len(starts) <= limit:
        return []
    levels = _boundaries(text, starts)
    budget = max(1, limit - overlap)
    count = lambda a, b: int(np.searchsorted(starts, b) - np.searchsorted(starts, a))

    def pack(a: int, b: int, level: int) -> list[tuple[int, int]]:
        if count(a, b) <= budget:
            return [(a, b)]
        cuts = levels[level]
        inner = cuts[np.searchsorted(cuts, a, "right"):np.searchsorted(cuts, b)]
        if level == len(levels) - 1:
            # Bare tokens: whole budgets.
            inner = inner[budget - 1::budget]
        edges = [a, *inner.tolist(), b]
        out: list[tuple[int, int]] = []
        size = 0
        for x, y in zip(edges, edges[1:]):
            parts = [(x, y)] if count(x, y) <= budget or level == len(levels) - 1 else pack(x, y, level + 1)
            for part in parts:
                n = count(*part)
                if out and size + n <= budget:
                    out[-1], size = (out[-1][0], part[1]), size + n
                else:
                    out.append(part)
                    size = n
        return out

    spans = pack(0, len(text), 0)
    # A small piece beside a large one: both are cut anew, at the strongest boundary that leaves both within the budget, next to the middle.
    for k in range(len(spans) - 1):
        (a, m), (_, b) = spans[k], spans[k + 1]
        if min(count(a, m), count(m, b)) >= budget * SMALL:
            continue
        for cuts in levels[:-2]:
            near = [c for c in cuts[np.searchsorted(cuts, a, "right"):np.searchsorted(cuts, b)].tolist() if max(count(a, c), count(c, b)) <= budget]
            if near:
                cut = min(near, key=lambda c: abs(count(a, c) - count(c, b)))
                if min(count(a, cut), count(cut, b)) > min(count(a, m), count(m, b)):
                    spans[k], spans[k + 1] = (a, cut), (cut, b)
                    break
    natural = levels[-3]
    pieces = []
    for k, (a, b) in enumerate(spans):
        early = a
        if k and overlap:
            first = int(np.searchsorted(starts, a))
            floor = max(int(starts[max(0, first - overlap)]), spans[k - 1][0])
            near = natural[np.searchsorted(natural, floor):np.searchsorted(natural, a)]
            early = int(near[0]) if len(near) else floor
        pieces.append((early, a, b))
    return pieces


def page_range(first: int, last: int, total: int, lo: int | None, hi: int | None) -> tuple[int | None, int | None]:
    """Pages of the tokens first to last (of total), spread evenly over pages lo to hi; swapped ends are put right, a missing one is the other."""
    lo, hi = (hi if lo is None else lo), (lo if hi is None else hi)
    if lo is None:
        return None, None
    lo, hi = min(lo, hi), max(lo, hi)
    span = hi - lo + 1
    return lo + first * span // total, lo + last * span // total


def _piece_batches(limit: int, overlap: int):
    schema = pa.schema(
        [("chunk_id", pa.int64()), ("piece_no", pa.int32()), ("n_pieces", pa.int32()), ("char_start", pa.int64()), ("char_end", pa.int64()),
         ("overlap_tokens", pa.int32()), ("token_count", pa.int32()), ("page_start", pa.int32()), ("page_end", pa.int32()), ("content", pa.string())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                key, text, lo, hi = (batch.column(c)[row].as_py() for c in ("chunk_id", "content", "page_start", "page_end"))
                pieces = split_text(text, limit, overlap)
                if not pieces:
                    continue
                starts = np.fromiter((m.start() for m in _TOKEN.finditer(text)), dtype=np.int64)
                out = []
                for no, (early, a, b) in enumerate(pieces):
                    i, j, k = (int(np.searchsorted(starts, x)) for x in (early, a, b))
                    pages = page_range(i, max(i, k - 1), len(starts), lo, hi)
                    out.append((key, no, len(pieces), early, b, j - i, k - i, *pages, text[early:b]))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return run


def split_oversized(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """The pieces of every chunk of more than ``limit`` tokens, counted anew whatever token_count says.

    (chunk_id, piece_no, n_pieces, char_start, char_end, overlap_tokens, token_count, page_start, page_end, content).
    No piece exceeds the limit, overlap included; without the overlaps the pieces make up the content. Chunks within the limit, null and
    empty contents have no pieces. chunks has one row a chunk_id. One task holds one text at a time.
    """
    long_enough = chunks.select("chunk_id", "content", F.col("page_start").cast("int").alias("page_start"), F.col("page_end").cast("int").alias("page_end")).filter(F.length("content") > limit)
    return long_enough.mapInArrow(
        _piece_batches(limit, overlap),
        "chunk_id long, piece_no int, n_pieces int, char_start long, char_end long, overlap_tokens int, token_count int, page_start int, page_end int, content string",
    )
