"""Problem 6: a global ranking from pairwise contests, by minorisation-maximisation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradewright.llm.consolidate import consolidate
from gradewright.operators.rank import global_rank
from gradewright.scratch import Scratch
from gradewright.skew import lookup

#: Opponents' strengths are binned to 1 / STEP logits within -REACH to REACH; an error far below any standard error.
STEP, REACH = 64, 16
#: Contests that everyone is taken to have won, and to have lost, against a player of strength 0.
PRIOR = 1.0
#: Rounds at most, and the mean change of strengths at which they end; the change of the last round is reported.
ROUNDS, CHANGE = 60, 0.01
#: Steps of minorisation-maximisation before the rest of the way, where it only crawls, is halved.
_INNER = 60


def _fit_batches(prior: float):
    """One player's strength, opponents given: MM steps until they stand still, and the curvature there.

    A player who won almost all contests moves by a fixed small share a step. What still moves after _INNER steps is finished by halving the interval
    in which the likelihood's slope, which MM drives to zero, changes its sign; so the fit is reached whatever the counts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("met")
            n = lists.value_lengths().to_numpy(zero_copy_only=False)
            met = lists.flatten()
            row = np.repeat(np.arange(len(n)), n)
            other = np.exp(met.field("level").to_numpy(zero_copy_only=False) / STEP - REACH)
            games = met.field("n").to_numpy(zero_copy_only=False).astype(float)
            wins = batch.column("wins").to_numpy(zero_copy_only=False) + prior
            own = np.ones(len(n))
            for _ in range(_INNER):
                new = wins / (np.bincount(row, games / (own[row] + other), len(n)) + 2 * prior / (own + 1))
                still = np.max(np.abs(np.log(new / own)), initial=0) < 1e-4
                own = new
                if still:
                    break
            else:
                slope = lambda x: wins - x * (np.bincount(row, games / (x[row] + other), len(n)) + 2 * prior / (x + 1))  # noqa: B023,E731
                low, high = np.full(len(n), -2.0 * REACH), np.full(len(n), 2.0 * REACH)
                for _ in range(40):
                    mid = (low + high) / 2
                    up = slope(np.exp(mid)) > 0
                    low, high = np.where(up, mid, low), np.where(up, high, mid)
                own = np.exp((low + high) / 2)
            p, q = own[row] / (own[row] + other), own / (own + 1)
            curve = np.bincount(row, games * p * (1 - p), len(n)) + 2 * prior * q * (1 - q)
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array(np.log(own)), pa.array(1 / np.sqrt(curve)), batch.column("games"), batch.column("wins"), batch.column("cnt")],
                ["key", "strength", "se", "games", "wins", "cnt"],
            )

    return run


def _level(x):
    return F.greatest(F.lit(0), F.least(F.lit(2 * REACH * STEP), F.round((x + REACH) * STEP))).cast("int")


def _half(pairs: DataFrame, key: str, other: str, won: str, strengths: DataFrame, prior: float) -> DataFrame:
    """(key, strength, se, games, wins, cnt) of one side, the other side's strengths (key, strength, cnt) given.

    A player's opponents are summed per strength level, so a player with a third of all contests has a bounded list.
    """
    rated = lookup(pairs, strengths.select(F.col("key").alias(other), _level(F.col("strength")).alias("level"), "cnt"), other)
    levels = rated.groupBy(F.col(key).alias("key"), "level").agg(F.sum("n").alias("n"), F.sum(won).alias("w"), F.count("*").alias("c"))
    met = levels.groupBy("key").agg(
        F.collect_list(F.struct("level", "n")).alias("met"), F.sum("n").alias("games"), F.sum("w").alias("wins"), F.sum("c").alias("cnt")
    )
    return met.mapInArrow(_fit_batches(prior), "key long, strength double, se double, games long, wins long, cnt long")


def rank_questions(attempts: DataFrame, prior: float = PRIOR, rounds: int = ROUNDS, change: float = CHANGE) -> DataFrame:
    """(question_id, rank, strength, se, games, wins, one_sided, component, last_change): all questions, strongest first.

    Every attempt is a contest of learner and question; the question wins if the answer is wrong. Strengths are those of
    a regularised logistic paired-comparison model. Contests are summed to win counts per pair, then the two sides are fitted in turn, each by
    minorisation-maximisation with the other side's strengths given, until they change by less than ``change`` on average;
    the first round starts from the questions' mean q_rating_before. se comes from the curvature at the fit, prior included.
    It takes the opponents' strengths as known, so it is too small for questions met by few learners.
    last_change is the mean change of the last round, below ``change`` unless ``rounds`` ended the fit.
    one_sided: all wins or all losses, where only the prior keeps the strength finite. component: questions of different
    components never met a common chain of learners, so only the prior makes their strengths comparable; it is named by one of its players.

    A repeated attempt_id counts once. Attempts with null question or outcome are left out. A learner without user_id is
    whoever has about that theta_before (a tenth of a logit), or one unknown player. Equal strengths rank by question_id.
    """
    scratch = Scratch(attempts.sparkSession, "ranking")
    hint = F.xxhash64(F.lit("level"), F.round("theta_before", 1).cast("string"))
    player = F.when(F.col("user_id").isNotNull(), F.xxhash64(F.lit("user"), "user_id")).otherwise(hint)
    contests = (
        attempts.filter("question_id is not null and correct is not null")
        .select("attempt_id", player.alias("player"), F.col("question_id").alias("question"), F.col("correct").cast("int").alias("win"), "q_rating_before")
    )
    once = contests.filter("attempt_id is not null").groupBy("attempt_id").agg(*[F.max(c).alias(c) for c in contests.columns[1:]])
    pairs = scratch.write(
        once.groupBy("player", "question").agg(
            F.count("*").cast("int").alias("n"), F.sum("win").cast("int").alias("win"), F.sum("q_rating_before").alias("hint"), F.count("q_rating_before").cast("int").alias("hints")
        ).withColumn("loss", F.col("n") - F.col("win"))
    )
    start = pairs.groupBy(F.col("question").alias("key")).agg(
        F.coalesce(F.sum("hint") / F.nullif(F.sum("hints"), F.lit(0)), F.lit(0.0)).alias("strength"), F.count("*").alias("cnt")
    )
    questions = scratch.write(start)
    slim = pairs.select("player", "question", "n", "win", "loss")
    moved = None
    for _ in range(rounds):
        learners = scratch.write(_half(slim, "player", "question", "win", questions, prior))
        fitted = scratch.write(_half(slim, "question", "player", "loss", learners, prior))
        moved = fitted.select("key", "strength").join(questions.select("key", F.col("strength").alias("was")), "key").agg(F.avg(F.abs(F.col("strength") - F.col("was")))).first()[0]
        scratch.drop(questions)
        questions = fitted
        if moved is None or moved < change:
            break
    # Components: each question stands for its busiest player, so the graph shrinks to links between players.
    busy = learners.select(F.col("key").alias("player"), "games", "cnt")
    hub = lookup(slim.select("player", "question"), busy, "player").groupBy("question").agg(F.max(F.struct("games", "player"))["player"].alias("hub"), F.count("*").alias("cnt"))
    hub = scratch.write(hub)
    links = lookup(slim.select("player", "question"), hub, "question").select("player", "hub").distinct()
    parts = consolidate(links).select(F.col("node").alias("hub"), F.col("group_id").alias("component"))
    named = lookup(hub.select("question", "hub"), scratch.write(hub.groupBy("hub").agg(F.count("*").alias("cnt")).join(parts, "hub")), "hub").select(F.col("question").alias("key"), "component")
    out = questions.join(named, "key").select(
        F.col("key").alias("question_id"), "strength", "se", "games", "wins", ((F.col("wins") == 0) | (F.col("wins") == F.col("games"))).alias("one_sided"), "component", F.lit(moved).cast("double").alias("last_change")
    )
    return global_rank(out, [F.desc("strength"), F.asc("question_id")])
