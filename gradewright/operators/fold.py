"""Ordered folds over keyed events, without gathering a group."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradewright import config as C
from gradewright.functions import learning as L

#: Attempts of a pair that are folded as one array.
GATHERED = 1_000


def ordered_fold(events: DataFrame, keys: list[str], order: list[str], start: Callable, step: Callable, finish: Callable, schema: str) -> DataFrame:
    """One pass over each key's events in order: state = step(state, row), then finish(key, state) gives rows.

    Rows are brought together by key and sorted on disk; a task streams through its keys and holds one
    state at a time, so a key with a third of all events costs one task time but no memory. Keys may be null
    (one key). An empty table gives no rows.
    """
    need = list(dict.fromkeys([*keys, *order, *events.columns]))
    placed = events.select(*need).repartition(*keys).sortWithinPartitions(*keys, *order)
    names = [x.strip().split(" ")[0] for x in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state, out = None, None, []
        for pdf in batches:
            pdf = pdf.astype(object).where(pdf.notna(), None)
            for row in pdf.itertuples(index=False):
                own = tuple(getattr(row, k) for k in keys)
                if state is None or own != key:
                    if state is not None:
                        out += finish(key, state)
                    key, state = own, start()
                state = step(state, row)
            if len(out) > 10_000:
                yield pd.DataFrame(out, columns=names)
                out = []
        if state is not None:
            out += finish(key, state)
        if out:
            yield pd.DataFrame(out, columns=names)

    return placed.mapInPandas(run, schema)


def weight(correct: bool, confidence: str | None) -> float:
    return C.CONFIDENCE["correct" if correct else "wrong", confidence if confidence in ("sure", "unsure") else "guessing"]


def _sigma(x: float) -> float:
    return 1 / (1 + math.exp(-x))


def _clamp(x: float) -> float:
    return max(-C.THETA_MAX, min(C.THETA_MAX, x))


def ability_fold(attempts: DataFrame) -> DataFrame:
    """(concept_id, kind, user_id, question_id, rating, n): abilities and question ratings after all attempts.

    Both move with every attempt. A question belongs to one concept, so folding concept by concept equals the fold over
    the whole log. Attempts need (attempt_id, user_id, question_id, concept_id, correct, confidence, created_at, q_start),
    where q_start is the question's rating before its first attempt; order is created_at, then attempt_id. Attempts with a
    null outcome are passed over; a null confidence counts as guessing.
    """

    def step(state, row):
        if row.correct is None:
            return state
        people, questions = state
        theta, n = people.get(row.user_id, (0.0, 0))
        q, m = questions.get(row.question_id, (row.q_start or 0.0, 0))
        gap = (1.0 if row.correct else 0.0) - _sigma(theta - q)
        w = weight(row.correct, row.confidence)
        k = max(C.K_MIN, min(C.K_MAX, C.K_BASE / (1 + n)))
        people[row.user_id] = (_clamp(theta + k * w * gap), n + 1)
        questions[row.question_id] = (_clamp(q - C.KQ_BASE / (1 + m) * w * gap), m + 1)
        return state

    def finish(key, state):
        people, questions = state
        return [(key[0], "learner", u, None, r, n) for u, (r, n) in people.items()] + [(key[0], "question", None, q, r, n) for q, (r, n) in questions.items()]

    return ordered_fold(
        attempts, ["concept_id"], ["created_at", "attempt_id"], lambda: ({}, {}), step, finish,
        "concept_id long, kind string, user_id string, question_id long, rating double, n long",
    )


def _days(events: DataFrame) -> tuple[DataFrame, Window, Window]:
    """events with their day; the order within a day of a learner and concept, and that of the days.

    Folds that can be said day by day are: a learner on one concept with a third of all attempts is then split by days.
    """
    day = events.withColumn("day", F.to_date("created_at"))
    within = Window.partitionBy("user_id", "concept_id", "day").orderBy("created_at", "attempt_id")
    return day, within, Window.partitionBy("user_id", "concept_id").orderBy("day")


def stability_fold(attempts: DataFrame) -> DataFrame:
    """(user_id, concept_id, stability, n) after all attempts, from 1; needs (user_id, concept_id, factor, created_at, attempt_id).

    s = max(floor, s * factor) is, in logarithms, a sum reflected at the floor: the sum, and how far it ever fell below the floor. Both
    are found for every day and then over the days. Null factors are passed over; pairs without any other have stability 1 and n 0.
    """
    rows, within, over = _days(attempts.select("user_id", "concept_id", "factor", "created_at", "attempt_id"))
    grown = F.sum(F.coalesce(F.log("factor"), F.lit(0.0))).over(within)
    daily = rows.withColumn("g", grown).groupBy("user_id", "concept_id", "day").agg(
        F.max_by("g", F.struct("created_at", "attempt_id")).alias("sum"), F.min("g").alias("low"), F.count("factor").alias("n")
    )
    upto = F.sum("sum").over(over)
    total = daily.select("user_id", "concept_id", "day", "n", upto.alias("sum"), (F.col("low") + upto - F.col("sum")).alias("low")).groupBy("user_id", "concept_id").agg(
        F.max_by("sum", F.coalesce("day", F.lit("0001-01-01").cast("date"))).alias("sum"), F.min("low").alias("low"), F.sum("n").alias("n")
    )
    return total.select("user_id", "concept_id", F.exp(F.col("sum") + F.greatest(F.lit(0.0), F.lit(math.log(C.STABILITY_MIN)) - F.col("low"))).alias("stability"), "n")


def seed_fold(attempts: DataFrame, gathered: int = GATHERED) -> DataFrame:
    """(user_id, concept_id, theta, n): abilities from 0 with a constant learning rate against fixed question ratings.

    Needs (user_id, concept_id, correct, confidence, q, created_at, attempt_id). Attempts with a null outcome are passed over. Pairs of up to ``gathered`` attempts
    are folded as sorted arrays; pairs with more are streamed, with the same result.
    """
    rows = attempts.filter("correct is not null").select(
        "user_id", "concept_id", "created_at", "attempt_id", F.coalesce("q", F.lit(0.0)).alias("q"), F.col("correct").cast("double").alias("y"), L.confidence_weight(F.col("correct"), F.col("confidence")).alias("w")
    ).withColumn("m", F.count("*").over(Window.partitionBy("user_id", "concept_id")))

    def one(theta, e):
        return L.clamp(theta + C.DIAGNOSTIC_K * e["w"] * (e["y"] - L.logistic(theta - e["q"])), -C.THETA_MAX, C.THETA_MAX)

    log = F.array_sort(F.collect_list(F.struct("created_at", "attempt_id", "q", "y", "w")))
    few = rows.filter(F.col("m") <= gathered).groupBy("user_id", "concept_id").agg(log.alias("log")).select(
        "user_id", "concept_id", F.aggregate("log", F.lit(0.0), one).alias("theta"), F.size("log").cast("long").alias("n")
    )
    many = ordered_fold(
        rows.filter(F.col("m") > gathered).drop("m"), ["user_id", "concept_id"], ["created_at", "attempt_id"], lambda: (0.0, 0),
        lambda s, r: (_clamp(s[0] + C.DIAGNOSTIC_K * r.w * (r.y - _sigma(s[0] - r.q))), s[1] + 1), lambda key, s: [(*key, *s)],
        "user_id string, concept_id long, theta double, n long",
    )
    return few.unionByName(many)


def misconception_step(state: int, correct: bool, confidence: str | None) -> int:
    """0 no flag; 1 an open flag; 2 an open flag with one sure and correct answer since; two of them clear it."""
    sure = confidence == "sure"
    if not correct:
        return 1 if sure or state else 0
    return {0: 0, 1: 2, 2: 0}[state] if sure else state


def misconception_fold(attempts: DataFrame) -> DataFrame:
    """(user_id, concept_id, flag) after all attempts, as by misconception_step.

    A sure and wrong answer opens; a sure and right one clears if the last answer before it that was wrong, or right and sure, was the
    latter. The flag is open if the last opening stands behind the last clearing, and is 2 if the last such answer was right and sure.
    Openings, clearings and the first and last such answers are found for every day, then over the days. Attempts with a null
    outcome are passed over; a pair with no others has no flag.
    """
    rows, within, over = _days(attempts.select("user_id", "concept_id", "correct", "confidence", "created_at", "attempt_id"))
    sure = F.coalesce(F.col("confidence") == "sure", F.lit(False))
    proves = F.when(F.col("correct") & sure, True).when(~F.col("correct"), False)
    rows = rows.withColumn("at", F.struct("created_at", "attempt_id")).withColumn("proves", proves)
    rows = rows.withColumn("before", F.last("proves", ignorenulls=True).over(within.rowsBetween(Window.unboundedPreceding, -1)))
    told = F.col("proves").isNotNull()
    daily = rows.groupBy("user_id", "concept_id", "day").agg(
        F.max(F.when(~F.col("correct") & sure, F.col("at"))).alias("opened"), F.max(F.when(F.col("proves") & F.col("before"), F.col("at"))).alias("cleared"),
        F.min(F.when(told, F.struct("at", "proves"))).alias("first"), F.max(F.when(told, F.struct("at", "proves"))).alias("last"),
    )
    earlier = F.last("last.proves", ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, -1))
    joins = F.when(F.col("first.proves") & earlier, F.col("first.at"))
    state = daily.select("user_id", "concept_id", "opened", F.greatest("cleared", joins).alias("cleared"), "last").groupBy("user_id", "concept_id").agg(
        F.max("opened").alias("opened"), F.max("cleared").alias("cleared"), F.max("last").alias("last")
    )
    is_open = F.col("opened").isNotNull() & (F.col("cleared").isNull() | (F.col("opened") > F.col("cleared")))
    return state.select("user_id", "concept_id", F.when(is_open, F.when(F.col("last.proves"), 2).otherwise(1)).otherwise(0).alias("flag"))


def learner_states(attempts: DataFrame) -> DataFrame:
    """(user_id, concept_id, theta, seen, n, stability, flag): the last ability and time, the number of attempts, and what stability_fold and misconception_fold give, in one pass.

    Needs (user_id, concept_id, theta_after, factor, correct, confidence, created_at, attempt_id). Attempts with a null outcome count in n, seen and theta only.
    """
    rows, within, over = _days(attempts.select("user_id", "concept_id", "theta_after", "factor", "correct", "confidence", "created_at", "attempt_id"))
    sure, at = F.coalesce(F.col("confidence") == "sure", F.lit(False)), F.struct("created_at", "attempt_id")
    proves = F.when(F.col("correct") & sure, True).when(~F.col("correct"), False)
    rows = rows.withColumns({"at": at, "proves": proves, "g": F.sum(F.coalesce(F.log("factor"), F.lit(0.0))).over(within)})
    rows = rows.withColumn("before", F.last("proves", ignorenulls=True).over(within.rowsBetween(Window.unboundedPreceding, -1)))
    told = F.col("proves").isNotNull()
    daily = rows.groupBy("user_id", "concept_id", "day").agg(
        F.max(F.struct("at", "g", "theta_after")).alias("end"), F.min("g").alias("low"), F.count("*").alias("n"),
        F.max(F.when(~F.col("correct") & sure, F.col("at"))).alias("opened"), F.max(F.when(F.col("proves") & F.col("before"), F.col("at"))).alias("cleared"),
        F.min(F.when(told, F.struct("at", "proves"))).alias("first"), F.max(F.when(told, F.struct("at", "proves"))).alias("last"),
    )
    upto = F.sum("end.g").over(over)
    earlier = F.last("last.proves", ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, -1))
    days = daily.withColumns({"sum": upto, "low": F.col("low") + upto - F.col("end.g"), "cleared": F.greatest("cleared", F.when(F.col("first.proves") & earlier, F.col("first.at")))})
    state = days.groupBy("user_id", "concept_id").agg(
        F.max(F.struct("end.at", "sum", "end.theta_after")).alias("end"), F.min("low").alias("low"), F.sum("n").alias("n"), F.max("opened").alias("opened"), F.max("cleared").alias("cleared"), F.max("last").alias("last"),
    )
    is_open = F.col("opened").isNotNull() & (F.col("cleared").isNull() | (F.col("opened") > F.col("cleared")))
    return state.select(
        "user_id", "concept_id", F.col("end.theta_after").alias("theta"), F.col("end.at.created_at").alias("seen"), "n",
        F.exp(F.col("end.sum") + F.greatest(F.lit(0.0), F.lit(math.log(C.STABILITY_MIN)) - F.col("low"))).alias("stability"),
        F.when(is_open, F.when(F.col("last.proves"), 2).otherwise(1)).otherwise(0).alias("flag"),
    )
