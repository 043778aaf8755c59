import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradewright.functions import learning as L
from gradewright.operators import draws
from gradewright.operators.draws import answers, paper_scores
from gradewright.plans.learning import _drawn


def test_answers_are_those_of_the_built_in_expressions(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(f"u{i % 7}", i, rng.gauss(0, 2), 1.2 / math.sqrt(1 + i % 5), rng.gauss(0, 2)) for i in range(70)]
    items = spark.createDataFrame(rows, "user_id string, question_id long, theta double, se double, q double")
    keys = ["user_id", "question_id"]
    drawn, right = _drawn(items, keys, keys, 200)
    want = {(r.question_id, r.b): r.right for r in drawn.select("question_id", "b", right.alias("right")).collect()}
    s = items.select(*[L.seed(F.lit(c), *map(F.col, keys)).alias(c) for c in "rax"], "theta", "se", "q").orderBy("question_id").toPandas()
    seeds = s[["r", "a", "x"]].to_numpy().T.astype(np.uint32)
    for doubt in (draws.DOUBT, 0.5):
        monkeypatch.setattr(draws, "DOUBT", doubt)
        tried, right = answers(seeds, s["theta"].to_numpy(), s["se"].to_numpy(), s["q"].to_numpy(), 200)
        assert {(i, b + 1): (int(right[i, b]) if tried[i, b] else None) for i in range(70) for b in range(200)} == want


@pytest.mark.parametrize("part", [1000, 2])
def test_paper_scores_against_the_loop(spark, monkeypatch, part):
    """Courses without a paper, without learners, learners without a state on an item, null abilities; items never leave a batch."""
    monkeypatch.setattr(draws, "PART", part)
    items = [(c, 10 * c + i, i % 4, "single" if i < 3 else "caselet 1", 1.0 + i % 2, 0.3 * i) for c in (1, 2, 4) for i in range(5)]
    states = [(f"u{u}", c, k, None if k == 2 else 0.2 * u - 0.1 * k, u + 1) for u in range(6) for c in (1, 2, 3) for k in range(u % 4, 9)]
    papers = spark.createDataFrame(items, "course_id long, question_id long, concept_id long, section string, marks double, q double")
    known = spark.createDataFrame(states, "user_id string, course_id long, concept_id long, theta double, n long")
    got = {(r.user_id, r.course_id, r.section): r for r in paper_scores(papers, known, 50).collect()}
    by = {(u, c, k): (t or 0.0, n) for u, c, k, t, n in states}
    rows = [(f"u{u}", *x, *by.get((f"u{u}", x[0], x[2]), (0.0, 0))) for u in range(6) for x in items if x[0] in (1, 2)]
    df = spark.createDataFrame(rows, "user_id string, course_id long, question_id long, concept_id long, section string, marks double, q double, theta double, n long").withColumn("se", 1.2 / F.sqrt(1.0 + F.col("n")))
    keys = ["user_id", "question_id"]
    drawn, right = _drawn(df, keys, keys, 50)
    mark = F.when(right == 1, F.col("marks")).when(right == 0, -0.25 * F.col("marks")).otherwise(0.0)
    scores = drawn.groupBy("user_id", "course_id", "b").agg(F.sum(mark).alias("s"), F.sum("marks").alias("of"))
    want = scores.groupBy("user_id", "course_id").agg(F.percentile("s", F.lit(0.025)).alias("low"), F.percentile("s", F.lit(0.975)).alias("high"), F.avg((F.col("s") >= 0.6 * F.col("of")).cast("double")).alias("p")).collect()
    assert len(want) == 12 and len(got) == 36
    for r in want:
        g = got[r.user_id, r.course_id, "all"]
        assert (round(g.low, 9), round(g.high, 9), g.p_pass, g.out_of) == (round(r.low, 9), round(r.high, 9), r.p, 7.0)
        assert g.coverage == sum(n > 0 for u, c, *_, n in rows if (u, c) == (r.user_id, r.course_id)) / 5
        assert got[r.user_id, r.course_id, "single"].out_of + got[r.user_id, r.course_id, "caselet 1"].out_of == 7.0
    assert paper_scores(papers.limit(0), known, 50).count() == 0


def test_draws_leave_no_rows_in_the_plan(spark):
    """A learner's 1,000 draws of an item are no rows: the query has no row a draw, so its work between tasks does not grow with the draws."""
    from gradewright.plans.gates import predicted_scores

    plan = predicted_scores(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(1, 1000" not in plan and "b#" not in plan.split("MapInArrow")[0]
