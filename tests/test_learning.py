import datetime as dt
import hashlib
import math
import random

import numpy as np
from pyspark.sql import functions as F

from gradewright import config as C
from gradewright.functions import learning as L
from gradewright.operators import fold
from gradewright.operators.apportion import largest_remainder, softmax_sample
from gradewright.operators.rank import global_rank
from gradewright.plans.learning import _priorities, bootstrap_band

T0 = dt.datetime(2030, 1, 1)


def _log(n=400, seed=1):
    rng = random.Random(seed)
    return [
        (i, f"u{rng.randrange(5)}", q := rng.randrange(12), q % 3, rng.random() < 0.6, rng.choice(["sure", "unsure", "guessing", None]), T0 + dt.timedelta(minutes=i), 0.1 * (q - 6))
        for i in range(n)
    ]


_SCHEMA = "attempt_id long, user_id string, question_id long, concept_id long, correct boolean, confidence string, created_at timestamp, q_start double"


def test_ability_fold_equals_the_sequential_log(spark):
    rows = _log()
    people, questions = {}, {}
    for _, u, q, c, ok, conf, _, q0 in rows:
        theta, n = people.get((u, c), (0.0, 0))
        r, m = questions.get(q, (q0, 0))
        e = 1 / (1 + math.exp(r - theta))
        w = C.CONFIDENCE["correct" if ok else "wrong", conf or "guessing"]
        k = min(max(0.6 / (1 + n), 0.08), 0.6)
        people[u, c] = (max(-6, min(6, theta + k * w * (ok - e))), n + 1)
        questions[q] = (max(-6, min(6, r + 0.15 / (1 + m) * w * (e - ok))), m + 1)
    shuffled = rows[:]
    random.Random(2).shuffle(shuffled)
    got = fold.ability_fold(spark.createDataFrame(shuffled, _SCHEMA)).collect()
    assert {(r.user_id, r.concept_id): (round(r.rating, 9), r.n) for r in got if r.kind == "learner"} == {k: (round(a, 9), n) for k, (a, n) in people.items()}
    assert {r.question_id: (round(r.rating, 9), r.n) for r in got if r.kind == "question"} == {k: (round(a, 9), n) for k, (a, n) in questions.items()}


def test_ability_recovery(spark):
    """Folded abilities correlate with those that made the answers."""
    rng = random.Random(7)
    truth = {c: rng.uniform(-2, 2) for c in range(12)}
    rows = []
    for i in range(1200):
        c = i % 12
        rows.append((i, "u", c * 10 + rng.randrange(5), c, rng.random() < 1 / (1 + math.exp(-truth[c])), "unsure", T0 + dt.timedelta(minutes=i), 0.0))
    got = {r.concept_id: r.rating for r in fold.ability_fold(spark.createDataFrame(rows, _SCHEMA)).filter("kind = 'learner'").collect()}
    xs, ys = [truth[c] for c in truth], [got[c] for c in truth]
    mx, my = sum(xs) / 12, sum(ys) / 12
    r = sum((a - mx) * (b - my) for a, b in zip(xs, ys)) / math.sqrt(sum((a - mx) ** 2 for a in xs) * sum((b - my) ** 2 for b in ys))
    assert r > 0.7


def test_misconception_states():
    s = 0
    for correct, confidence, after in [(True, "sure", 0), (False, "sure", 1), (True, "unsure", 1), (True, "sure", 2), (False, "unsure", 1), (True, "sure", 2), (True, "sure", 0), (False, None, 0)]:
        s = fold.misconception_step(s, correct, confidence)
        assert s == after


def test_stability_floor_and_nulls(spark):
    rows = [("u", 1, 1, T0, 0.01), ("u", 1, 2, T0, None), ("u", 1, 3, T0 + dt.timedelta(1), 2.0), (None, 2, 4, T0, 1.5)]
    got = {(r.user_id, r.concept_id): (r.stability, r.n) for r in fold.stability_fold(spark.createDataFrame(rows, "user_id string, concept_id long, attempt_id long, created_at timestamp, factor double")).collect()}
    assert got == {("u", 1): (1.0, 2), (None, 2): (1.5, 1)}


def test_folds_of_built_ins_equal_the_steps(spark):
    rng = random.Random(6)
    rows = [
        (i, rng.choice(["a", "b", None]), rng.randrange(3), rng.choice([True, False, None]), rng.choice(["sure", "sure", "unsure", None]), T0 + dt.timedelta(hours=rng.randrange(400)), rng.choice([None, rng.uniform(0.2, 2.2)]), rng.choice([None, rng.uniform(-1, 1)]))
        for i in range(700)
    ]
    df = spark.createDataFrame(rows, "attempt_id long, user_id string, concept_id long, correct boolean, confidence string, created_at timestamp, factor double, q double")
    stable, flags, seeds = {}, {}, {}
    for i, u, c, ok, conf, _, f, q in sorted(rows, key=lambda r: (r[5], r[0])):
        s, n = stable.get((u, c), (1.0, 0))
        stable[u, c] = (max(C.STABILITY_MIN, s * f), n + 1) if f is not None else (s, n)
        flags.setdefault((u, c), 0)
        if ok is not None:
            flags[u, c] = fold.misconception_step(flags[u, c], ok, conf)
            t, n = seeds.get((u, c), (0.0, 0))
            seeds[u, c] = (max(-6, min(6, t + C.DIAGNOSTIC_K * fold.weight(ok, conf) * (ok - 1 / (1 + math.exp((q or 0.0) - t))))), n + 1)
    got = {(r.user_id, r.concept_id): (round(r.stability, 9), r.n) for r in fold.stability_fold(df).collect()}
    assert got == {k: (round(s, 9), n) for k, (s, n) in stable.items()}
    assert {(r.user_id, r.concept_id): r.flag for r in fold.misconception_fold(df).collect()} == flags
    states = fold.learner_states(df.withColumn("theta_after", F.col("attempt_id").cast("double")).withColumn("factor", F.when(F.col("correct").isNotNull(), F.col("factor"))))
    by_time = sorted(rows, key=lambda r: (r[5], r[0]))
    for r in states.collect():
        own = [x for x in by_time if (x[1], x[2]) == (r.user_id, r.concept_id)]
        s = 1.0
        for x in own:
            s = max(C.STABILITY_MIN, s * x[6]) if x[6] is not None and x[3] is not None else s
        assert (r.theta, r.seen, r.n, r.flag, round(r.stability, 9)) == (own[-1][0], own[-1][5], len(own), flags[r.user_id, r.concept_id], round(s, 9))
    for limit in (1_000, 70):
        assert {(r.user_id, r.concept_id): (round(r.theta, 9), r.n) for r in fold.seed_fold(df, limit).collect()} == {k: (round(t, 9), n) for k, (t, n) in seeds.items()}


def test_uniforms_are_even_and_apart(spark):
    rows = spark.range(40).select(F.col("id"), L.seed(F.col("id")).alias("s")).withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(2000)))).withColumn("u", L.counted_uniform(F.col("s"), F.col("b")))
    cells = rows.groupBy(F.floor(F.col("u") * 20)).count().collect()
    assert len(cells) == 20 and all(abs(r["count"] - 4000) < 350 for r in cells)
    wide = rows.groupBy("b").pivot("id", list(range(8))).agg(F.first("u"))
    worst = wide.select([F.abs(F.corr(str(i), str(j))) for i in range(8) for j in range(i)]).first()
    assert max(worst) < 0.1


def test_folds_of_nothing(spark):
    assert fold.ability_fold(spark.createDataFrame([], _SCHEMA)).count() == 0


def test_expressions(spark):
    df = spark.createDataFrame([(0.3, 2.0, True, "sure"), (0.3, 0.0, False, None)], "t double, s double, ok boolean, c string")
    row = df.select(
        L.mastery(F.col("t")).alias("m"), L.retrievability(F.col("s"), F.lit(2.0)).alias("r"), L.confidence_weight(F.col("ok"), F.col("c")).alias("w"),
        L.days_until_due(F.col("s")).alias("d"), L.expected_value(F.lit(0.1), F.lit(1.0)).alias("skip"), L.expected_value(F.lit(0.2), F.lit(1.0)).alias("even"),
    ).collect()
    assert abs(row[0].m - 0.5) < 1e-12 and abs(row[0].r - math.exp(-1)) < 1e-12 and row[0].w == 1.0 and abs(row[0].d + 2 * math.log(0.85)) < 1e-12
    assert row[1].r == 0.0 and row[1].w == 0.6 and row[0].skip == 0.0 and abs(row[0].even) < 1e-12


def test_seats_sum_and_zero_weights(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (1, "b", 1.0), (1, "c", 1.0), (2, "a", 0.0), (2, "b", None), (3, "a", 5.0), (3, "b", -1.0)], "g long, id string, w double")
    got = {(r.g, r.id): r.seats for r in largest_remainder(df, ["g"], "w", 10, "id").collect()}
    assert got == {(1, "a"): 4, (1, "b"): 3, (1, "c"): 3, (2, "a"): 5, (2, "b"): 5, (3, "a"): 10, (3, "b"): 0}


def test_softmax_sample_follows_the_scores(spark):
    df = spark.range(4000).selectExpr("id AS g").crossJoin(spark.createDataFrame([("a", 0.9), ("b", 0.2)], "id string, s double"))
    n = softmax_sample(df, ["g"], "s", 1, [F.col("g"), F.col("id")]).filter("id = 'a'").count()
    want = 4000 / (1 + math.exp(-0.7 / 0.7))
    assert abs(n - want) < 130


def test_global_rank(spark):
    rows = [(i, float((i * 37) % 101)) for i in range(300)]
    got = {r.id: r["rank"] for r in global_rank(spark.createDataFrame(rows, "id long, v double"), [F.desc("v"), F.asc("id")]).collect()}
    assert got == {i: k for k, (i, _) in enumerate(sorted(rows, key=lambda x: (-x[1], x[0])), 1)}
    assert global_rank(spark.createDataFrame([], "v double"), [F.asc("v")]).count() == 0


def test_priorities_use_stability_and_flag_of_every_state(spark, tmp_path):
    rng = random.Random(3)
    rows = [
        (i, rng.choice(["u1", "u2", None]), rng.randrange(25), rng.uniform(-2, 2), rng.random() < 0.5, rng.choice(["sure", "sure", "unsure", None]), T0 + dt.timedelta(hours=i // 2))
        for i in range(600)
    ]
    schema = "attempt_id long, user_id string, concept_id long, theta_after double, correct boolean, confidence string, created_at timestamp"
    spark.createDataFrame(random.Random(4).sample(rows + rows[:50], 650), schema).write.parquet(f"{tmp_path}/attempt_outcomes.parquet")
    states = {}
    for _, u, c, theta, ok, conf, at in rows:
        s, flag, n = states.get((u, c), (1.0, 0, 0, 0, 0))[:3]
        w, m = fold.weight(ok, conf), 1 / (1 + math.exp(0.3 - theta))
        factor = 1 + (C.GROW_BASE + (C.GROW_MASTERY - C.GROW_BASE) * m - 1) * w if ok else C.FAIL_MULT / w
        states[u, c] = (max(C.STABILITY_MIN, s * factor), fold.misconception_step(flag, ok, conf), n + 1, m, at)
    want = {
        k: C.WEIGHT_WEAK * (1 - m) + C.WEIGHT_OVERDUE * (1 - math.exp(-(rows[-1][6] - at).total_seconds() / 86400 / s)) + C.WEIGHT_MISCONCEPTION * (flag > 0) + C.WEIGHT_NOVELTY / (1 + n)
        for k, (s, flag, n, m, at) in states.items()
    }
    got = {(r.user_id, r.concept_id): r.priority for r in _priorities(spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)


def test_band_rests_on_a_thousand_draws(spark, tmp_path):
    rows = [(i, f"u{i % 2}", i, i % 3, 0.1 * (i % 5), 0.2 * (i % 7) - 0.6, T0 + dt.timedelta(hours=i)) for i in range(24)]
    schema = "attempt_id long, user_id string, question_id long, concept_id long, theta_after double, q_rating_before double, created_at timestamp"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/attempt_outcomes.parquet")

    def u(*parts):
        x = (int(hashlib.md5("|".join(map(str, parts[:-1])).encode()).hexdigest()[:8], 16) + parts[-1] * 2654435769) % 2**32
        for _ in range(2):
            x = (x ^ x >> 16) * 73244475 % 2**32
        return ((x ^ x >> 16) + 0.5) / 2**32

    last = {(r[1], r[3]): r[4] for r in rows}
    n = {k: sum((r[1], r[3]) == k for r in rows) for k in last}
    scores = {user: np.zeros(1000) for user in ("u0", "u1")}
    for attempt, user, _, concept, _, q, _ in rows:
        for b in range(1, 1001):
            z = math.sqrt(-2 * math.log(u("r", user, concept, b))) * math.cos(2 * math.pi * u("a", user, concept, b))
            p = 1 / (1 + math.exp(q - last[user, concept] - C.SE_BASE / math.sqrt(1 + n[user, concept]) * z))
            scores[user][b - 1] += 0 if p < 0.2 else 1 if u("x", user, attempt, b) < p else -0.25
    got = {r.user_id: (r.low, r.high, r.mean) for r in bootstrap_band(spark, str(tmp_path)).collect()}
    assert got.keys() == scores.keys()
    for user, s in scores.items():
        assert np.allclose(got[user], [*np.percentile(s, [2.5, 97.5]), s.mean()], atol=1e-6)
