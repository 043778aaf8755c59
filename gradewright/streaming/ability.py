"""Streaming twins of the batch queries on the attempt log."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gradewright import config as C
from gradewright.operators.fold import _clamp, _sigma, weight


def ability_stream(attempts: DataFrame) -> DataFrame:
    """Abilities and question ratings, updated by every micro-batch; the state after in-order input equals ability_fold().

    attempts: a stream with the columns of ability_fold(). State is kept by concept; within a micro-batch attempts are taken in order of
    created_at and attempt_id, between micro-batches in order of arrival, so an attempt that arrives after later ones counts when it
    arrives. A repeated attempt_id should be dropped before (dropDuplicatesWithinWatermark). Output mode: update.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        people, questions = (json.loads(x) for x in state.get) if state.exists else ({}, {})
        rows = pd.concat(list(batches)).sort_values(["created_at", "attempt_id"])
        rows = rows.astype(object).where(rows.notna(), None)
        moved_p, moved_q = set(), set()
        for r in rows.itertuples(index=False):
            if r.correct is None:
                continue
            u, q = str(r.user_id), str(r.question_id)
            theta, n = people.get(u, (0.0, 0))
            rating, m = questions.get(q, (r.q_start or 0.0, 0))
            gap = (1.0 if r.correct else 0.0) - _sigma(theta - rating)
            w = weight(r.correct, r.confidence)
            people[u] = (_clamp(theta + max(C.K_MIN, min(C.K_MAX, C.K_BASE / (1 + n))) * w * gap), n + 1)
            questions[q] = (_clamp(rating - C.KQ_BASE / (1 + m) * w * gap), m + 1)
            moved_p.add(u)
            moved_q.add(q)
        state.update((json.dumps(people), json.dumps(questions)))
        out = [(key[0], "learner", u, None, *people[u]) for u in sorted(moved_p)] + [(key[0], "question", None, int(q), *questions[q]) for q in sorted(moved_q)]
        yield pd.DataFrame(out, columns=["concept_id", "kind", "user_id", "question_id", "rating", "n"])

    return attempts.groupBy("concept_id").applyInPandasWithState(
        step, "concept_id long, kind string, user_id string, question_id long, rating double, n long", "people string, questions string", "update", GroupStateTimeout.NoTimeout
    )


def accuracy_windows(attempts: DataFrame, lateness: str = "2 days", length: str = "1 day") -> DataFrame:
    """(start, concept_id, n, right): attempts and right answers by day and concept, for a stream or a table.

    Event time is created_at. Attempts over ``lateness`` behind the latest seen are dropped by the stream; a batch refold counts them.
    """
    return (
        attempts.withWatermark("created_at", lateness)
        .groupBy(F.window("created_at", length), "concept_id").agg(F.count("*").alias("n"), F.count_if("correct").alias("right"))
        .select(F.col("window.start").alias("start"), "concept_id", "n", "right")
    )


def study_sessions(attempts: DataFrame, gap: str = "30 minutes", lateness: str = "2 days") -> DataFrame:
    """(user_id, start, finish, n): stretches of attempts of a learner without a pause of ``gap``, for a stream or a table."""
    return (
        attempts.withWatermark("created_at", lateness)
        .groupBy(F.session_window("created_at", gap), "user_id").agg(F.count("*").alias("n"))
        .select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("finish"), "n")
    )
