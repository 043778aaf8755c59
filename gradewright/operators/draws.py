"""Scores of learners on papers over repeated draws, counted in batches."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradewright import config as C
from gradewright.scratch import Scratch

#: Learners of a course that are drawn for together, and those of a task.
PART, TASK = 1000, 2000
#: Items whose draws are held at a time.
ITEMS = 32
#: How far single precision may be off: in logits, and as a share of a probability. Draws as near as this to a decision are made again in double precision.
DOUBT = 1e-4
#: Break-even of an answer, in logits.
EVEN = float(np.log(C.NEGATIVE))


def _mixed(start: np.ndarray, step: np.ndarray, x: np.ndarray, t: np.ndarray) -> np.ndarray:
    """The 32 bits of functions.learning.counted_uniform(), in x; t is room."""
    np.add(start, step, out=x)
    for _ in range(2):
        np.right_shift(x, 16, out=t)
        np.bitwise_xor(x, t, out=x)
        np.multiply(x, 73244475, out=x)
    np.right_shift(x, 16, out=t)
    return np.bitwise_xor(x, t, out=x)


def _uniform(start: np.ndarray, step: np.ndarray) -> np.ndarray:
    return (_mixed(start, step, np.empty_like(start), np.empty_like(start)) + 0.5) / 4294967296.0


def answers(seeds: np.ndarray, theta: np.ndarray, se: np.ndarray, q: np.ndarray, draws: int) -> tuple[np.ndarray, np.ndarray]:
    """(attempted, right) by item and draw 1 to ``draws``: an ability is drawn normally around theta; the item is attempted where its p(success) is at break-even or above, and right where a third number is below p.

    seeds: three rows of 32 bits, as for plans.learning._drawn(). Single precision decides all draws but those in DOUBT.
    """
    n = len(theta)
    step = (np.arange(1, draws + 1, dtype=np.uint64) * 2654435769).astype(np.uint32)
    tried, right = np.empty((n, draws), bool), np.empty((n, draws), bool)
    doubts = []
    off = (theta - q)[:, None].astype(np.float32)
    doubt = DOUBT + 1e-6 * float(np.max(np.abs(off), initial=0, where=np.isfinite(off)))
    size = (min(ITEMS, n), draws)
    x, t, f, g, bad, one = np.empty(size, np.uint32), np.empty(size, np.uint32), np.empty(size, np.float32), np.empty(size, np.float32), np.empty(size, bool), np.empty(size, bool)
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        for lo in range(0, n, ITEMS):
            hi = min(n, lo + ITEMS)
            if hi - lo < len(x):
                x, t, f, g, bad, one = (a[: hi - lo] for a in (x, t, f, g, bad, one))
            s1, s2, s3 = seeds[:, lo:hi, None]
            np.copyto(f, _mixed(s1, step, x, t), casting="unsafe")
            np.greater(x, 4294537798, out=bad)  # near 1 the logarithm loses its digits
            f += np.float32(0.5)
            f *= np.float32(2.0**-32)
            np.log(f, out=f)
            f *= np.float32(-2)
            np.sqrt(f, out=f)
            np.copyto(g, _mixed(s2, step, x, t), casting="unsafe")
            g *= np.float32(6.283185307179586 * 2.0**-32)
            f *= np.cos(g, out=g)
            f *= se[lo:hi, None].astype(np.float32)
            f += off[lo:hi]
            np.negative(f, out=g)
            np.exp(g, out=g)
            g += np.float32(1)
            f -= np.float32(EVEN)
            np.greater_equal(f, 0, out=tried[lo:hi])
            np.abs(f, out=f)
            np.logical_or(bad, np.less(f, np.float32(doubt), out=one), out=bad)
            np.copyto(f, _mixed(s3, step, x, t), casting="unsafe")
            f += np.float32(0.5)
            f *= np.float32(2.0**-32)
            f *= g
            f -= np.float32(1)
            np.less(f, 0, out=right[lo:hi])
            np.abs(f, out=f)
            np.logical_or(bad, np.less(f, np.float32(doubt), out=one), out=bad)
            doubts.append(np.flatnonzero(bad) + lo * draws)
        i, b = np.divmod(np.concatenate(doubts), draws)
        u1, u2, u3 = (_uniform(s[i], step[b]) for s in seeds)
        z = np.sqrt(-2 * np.log(u1)) * np.cos(6.283185307179586 * u2)
        p = 1 / (1 + np.exp(-(theta[i] + se[i] * z - q[i])))
    tried[i, b], right[i, b] = p >= C.NEGATIVE / (1 + C.NEGATIVE), u3 < p
    tried[np.isnan(off[:, 0])] = right[np.isnan(off[:, 0])] = True  # NaN is the largest number in SQL
    right &= tried
    return tried, right


def _point(ordered: np.ndarray, share: float) -> float:
    """The percentile, interpolated as percentile() does it."""
    at = share * (len(ordered) - 1)
    low, high = int(np.floor(at)), int(np.ceil(at))
    if low == high or ordered[low] == ordered[high]:
        return float(ordered[low])
    return float((high - at) * ordered[low] + (at - low) * ordered[high])


class _Paper:
    """The items of a course's paper, those of a section and of equal marks together."""

    def __init__(self, items: pa.StructArray):
        part = {c: items.field(c).to_numpy(zero_copy_only=False) for c in ("question_id", "concept_id", "marks", "q")}
        section = np.array(items.field("section").to_pylist())
        order = np.lexsort((part["marks"], section))
        self.section = section[order]
        self.marks, self.q, self.concept = (part[c][order] for c in ("marks", "q", "concept_id"))
        self.ids = [str(x).encode() for x in part["question_id"][order].tolist()]
        self.names = np.unique(self.section).tolist()
        starts = np.flatnonzero(np.r_[True, (self.section[1:] != self.section[:-1]) | (self.marks[1:] != self.marks[:-1])])
        self.runs = list(zip(starts.tolist(), [*starts[1:].tolist(), len(order)]))

    def rows(self, user: str, concepts: np.ndarray, theta: np.ndarray, n: np.ndarray, draws: int) -> Iterator[tuple]:
        """(section, expected, out_of, low, high, p_pass, coverage) of every section and of all."""
        order = np.argsort(concepts)
        at = np.searchsorted(concepts, self.concept, sorter=order)
        at = order[np.minimum(at, len(order) - 1)]
        known = concepts[at] == self.concept
        ability = np.where(known & ~theta.mask[at], theta.data[at], 0.0)
        count = np.where(known, n[at], 0)
        heads = [f"{c}|{user}|".encode() for c in "rax"]
        seeds = np.frombuffer(b"".join(md5(h + q).digest()[:4] for h in heads for q in self.ids), ">u4").astype(np.uint32).reshape(3, -1)
        tried, right = answers(seeds, ability, C.SE_BASE / np.sqrt(1.0 + count), self.q, draws)
        score = {s: np.zeros(draws) for s in self.names}
        for lo, hi in self.runs:
            mark = self.marks[lo]
            rights, tries = (m[lo:hi].view(np.uint8).sum(axis=0, dtype=np.int32) for m in (right, tried))
            score[self.section[lo]] += mark * rights - C.NEGATIVE * mark * (tries - rights)
        with np.errstate(over="ignore"):
            p = 1 / (1 + np.exp(-(ability - self.q)))
        gain = np.where(p < C.NEGATIVE / (1 + C.NEGATIVE), 0.0, p * self.marks - (1 - p) * C.NEGATIVE * self.marks)
        for s in [*self.names, "all"]:
            own = slice(None) if s == "all" else self.section == s
            drawn = np.sort(sum(score.values()) if s == "all" else score[s])
            of = float(self.marks[own].sum())
            passed = float(np.count_nonzero(drawn >= C.PASS_SHARE * of)) / draws
            yield s, float(gain[own].sum()), of, _point(drawn, C.INTERVAL[0]), _point(drawn, C.INTERVAL[1]), passed, float((count[own] > 0).mean())


def paper_scores(papers: DataFrame, states: DataFrame, draws: int) -> DataFrame:
    """(user_id, course_id, section, expected, out_of, low, high, p_pass, coverage) of every learner on the course's paper, by section and (section ``all``) in all.

    papers: (course_id, question_id, concept_id, section, marks, q). states: (user_id, course_id, concept_id, theta, n), one row a learner, course and concept. The learners of
    a course are cut into parts, each of which has the paper before it, so no item is multiplied by learners or draws outside a batch, and only sums leave it.
    """
    scratch = Scratch(papers.sparkSession, "draws")
    item = F.struct("question_id", "concept_id", "section", "marks", "q")
    paper = papers.groupBy("course_id").agg(F.collect_list(item).alias("items"))  # a paper's hundred
    own = states.groupBy("course_id", "user_id").agg(F.collect_list(F.struct("concept_id", "theta", "n")).alias("states"))
    own = scratch.write(own.join(paper.select("course_id"), "course_id", "left_semi"))
    sizes = scratch.write(own.groupBy("course_id").agg(F.count("*").alias("learners")).withColumn("parts", F.ceil(F.col("learners") / PART).cast("int")))
    total = sizes.agg(F.sum("learners")).first()[0] or 0
    tasks = max(int(papers.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK))
    placed = own.join(sizes.select("course_id", "parts"), "course_id").withColumn("part", F.pmod(F.xxhash64("user_id"), F.col("parts")).cast("int")).drop("parts")
    heads = paper.join(sizes.select("course_id", "parts"), "course_id").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    both = placed.unionByName(heads, allowMissingColumns=True).repartition(tasks, "course_id", "part").sortWithinPartitions("course_id", "part", F.col("user_id").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            courses, users = batch.column("course_id").to_pylist(), batch.column("user_id").to_pylist()
            lists = batch.column("states")
            ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)).tolist()
            flat = lists.flatten()
            concepts, n = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("concept_id", "n"))
            theta = flat.field("theta")
            theta = np.ma.MaskedArray(pc.fill_null(theta, 0.0).to_numpy(zero_copy_only=False), mask=theta.is_null().to_numpy(zero_copy_only=False))
            out = []
            for k, (course, user) in enumerate(zip(courses, users)):
                if user is None:
                    now = _Paper(batch.column("items")[k].values)
                    continue
                mine = slice(ends[k - 1] if k else 0, ends[k])
                out += [(user, course, *r) for r in now.rows(user, concepts[mine], theta[mine], n[mine], draws)]
            columns = list(zip(*out)) or [()] * 9
            kinds = [pa.string(), pa.int64(), pa.string()] + [pa.float64()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["user_id", "course_id", "section", "expected", "out_of", "low", "high", "p_pass", "coverage"])

    kinds = "user_id string, course_id long, section string, expected double, out_of double, low double, high double, p_pass double, coverage double"
    return both.select("course_id", "user_id", "states", "items").mapInArrow(run, kinds)
