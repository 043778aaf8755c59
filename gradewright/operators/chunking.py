"""Page text packed into token-bounded chunks that overlap."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from gradewright import config as C

# A token, the end of a sentence, the first words of an example.
_TOKEN = re.compile(r"\w+|[^\w\s]")
_CUT = re.compile(r"(?<=[.!?])\s+")
_BLOCK = re.compile(r"\s*(?:example|illustration|case)\b", re.I)


def units_of_page(text: str | None) -> list[str]:
    """Sentences of prose, and whole tables and examples, in order."""
    out: list[str] = []
    prose: list[str] = []
    block: list[str] = []
    kind = "prose"

    def flush() -> None:
        nonlocal prose, block
        if prose:
            out.extend(s.strip() for s in _CUT.split(" ".join(prose)) if s.strip())
        if block:
            out.append("\n".join(block))
        prose, block = [], []

    for line in (text or "").split("\n"):
        is_table = " | " in line
        if kind == "table" and not is_table or kind == "example" and (is_table or not line.strip()):
            flush()
            kind = "prose"
        if is_table and kind != "table":
            flush()
            kind = "table"
        elif kind == "prose" and _BLOCK.match(line):
            flush()
            kind = "example"
        if kind != "prose":
            block.append(line)
        elif line.strip():
            prose.append(line.strip())
    flush()
    return out


class Limits(NamedTuple):
    """Tokens of a chunk: where it may end, what is too small to stand alone, the most, and what the next repeats."""

    target: int = C.CHUNK_TARGET
    least: int = C.CHUNK_MIN
    most: int = C.CHUNK_MAX
    budget: int = int(C.CHUNK_TARGET * C.CHUNK_OVERLAP)


def settled_spans(ends: np.ndarray, begin: int, fresh: int, limits: Limits) -> tuple[list[tuple[int, int]], int, int]:
    """Spans of units that no later unit can change, and where the next span begins and has its first fresh unit.

    ``ends[i]`` is the tokens of the first i units. The end of a span is found by bisection in these sums: the first end at or over the
    target, unless the maximum is passed before. The next span begins with as many whole units as the overlap
    has tokens for. Where not one fresh unit fits behind that overlap, the overlap is a span by itself and the unit joins it next.
    """
    spans: list[tuple[int, int]] = []
    n, cut_short = len(ends) - 1, False
    while True:
        full = int(np.searchsorted(ends, ends[begin] + limits.target, "left"))
        within = int(np.searchsorted(ends, ends[begin] + limits.most, "right")) - 1
        if begin < fresh < n and within == fresh and not cut_short:
            spans.append((begin, fresh))
        stop = max(fresh + 1, min(full, within))
        if stop > n or within >= n < full:
            return spans, begin, fresh
        spans.append((begin, stop))
        cut_short = ends[stop] - ends[begin] < limits.target
        begin, fresh = max(begin, int(np.searchsorted(ends, ends[stop] - limits.budget, "left"))), stop


def final_spans(spans: list[tuple[int, int]], ends: np.ndarray, begin: int, fresh: int, limits: Limits) -> list[tuple[int, int]]:
    """The last spans with what is left: a small rest lengthens the span before it, if that stays within the maximum."""
    n = len(ends) - 1
    if fresh >= n:
        return spans
    if spans and ends[n] - ends[begin] < limits.least and ends[n] - ends[spans[-1][0]] <= limits.most:
        return [*spans[:-1], (spans[-1][0], n)]
    return [*spans, (begin, n)]


class _Source:
    """The units of one source that are not settled yet; the last span waits for the rest."""

    def __init__(self, limits: Limits):
        self.limits, self.units, self.sizes = limits, [], [0]
        self.begin = self.fresh = 0
        self.last: list[tuple[int, int]] = []

    def add(self, page: int, units: list[str]) -> list[list[tuple[int, str]]]:
        for u in units:
            self.units.append((page, u))
            self.sizes.append(self.sizes[-1] + len(_TOKEN.findall(u)))
        found, self.begin, self.fresh = settled_spans(np.array(self.sizes), self.begin, self.fresh, self.limits)
        spans = self.last + found
        out, self.last = [self.units[a:b] for a, b in spans[:-1]], spans[-1:]
        drop = min([self.begin, *(a for a, _ in self.last)])
        self.units, self.sizes = self.units[drop:], self.sizes[drop:]
        self.begin, self.fresh, self.last = self.begin - drop, self.fresh - drop, [(a - drop, b - drop) for a, b in self.last]
        return out

    def rest(self) -> list[list[tuple[int, str]]]:
        return [self.units[a:b] for a, b in final_spans(self.last, np.array(self.sizes), self.begin, self.fresh, self.limits)]


def pack_pages(pages: DataFrame) -> DataFrame:
    """(source_id, chunk_no, content, content_hash, token_count, page_start, page_end) from (source_id, page_number, text).

    Units are packed in order: a chunk ends where it reaches the target, or before a unit that would take it over the maximum; see settled_spans.
    Pages are brought together by source and streamed in order; a task holds a page and the open chunk, not a source. Null and blank
    pages add nothing. A unit larger than the maximum becomes a chunk of its own size.
    """
    placed = pages.select("source_id", "page_number", "text").repartition("source_id").sortWithinPartitions("source_id", "page_number", "text")
    names = ["source_id", "chunk_no", "content", "content_hash", "token_count", "page_start", "page_end"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        source, own, no = None, None, 0

        def rows(chunks):
            nonlocal no
            out = []
            for chunk in chunks:
                text = "\n".join(u for _, u in chunk).strip()
                pages_in = [p for p, _ in chunk]
                out.append((source, no, text, hashlib.sha256(text.encode()).hexdigest(), len(_TOKEN.findall(text)), min(pages_in), max(pages_in)))
                no += 1
            return out

        for pdf in batches:
            out = []
            for key, page, text in zip(pdf["source_id"], pdf["page_number"], pdf["text"]):
                if own is None or key != source:
                    if own is not None:
                        out += rows(own.rest())
                    source, own, no = key, _Source(Limits()), 0
                out += rows(own.add(int(page), units_of_page(text)))
            if out:
                yield pd.DataFrame(out, columns=names)
        if own is not None and (out := rows(own.rest())):
            yield pd.DataFrame(out, columns=names)

    return placed.mapInPandas(run, "source_id long, chunk_no int, content string, content_hash string, token_count int, page_start int, page_end int")
