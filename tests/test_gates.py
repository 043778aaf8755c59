import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradewright.functions.json import faults_of, schema_faults, setting
from gradewright.functions.learning import card_factor
from gradewright.operators import vectors
from gradewright.operators.vectors import accepted_in_turn, near_links, rejected_in_turn
from gradewright.plans.gates import eligible_counts, open_caselets
from gradewright.plans.vectors import merged_concepts

T0 = dt.datetime(2030, 1, 1)


def _in_turn(nodes, links):
    taken = set()
    for v in sorted(nodes):
        if not any((u, v) in links for u in taken):
            taken.add(v)
    return taken


@pytest.mark.parametrize("few", [400_000, 5, 0])
def test_rejected_in_turn_against_the_loop(spark, few):
    rng = random.Random(few)
    links = {(u, v) for u, v in ((rng.randrange(60), rng.randrange(60)) for _ in range(110)) if u < v} | {(i, i + 1) for i in range(100, 120)}
    nodes = {x for e in links for x in e}
    got = {r.id for r in rejected_in_turn(spark.createDataFrame([*links, next(iter(links))], "u long, v long"), few).collect()}
    assert got == nodes - _in_turn(nodes, links)
    assert rejected_in_turn(spark.createDataFrame([], "u long, v long")).count() == 0


def test_accepted_in_turn(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((40, 16))
    m = np.vstack([base, base[:20] + 0.2 * rng.standard_normal((20, 16)), base[:10], base[:10], np.zeros((2, 16))])
    rows = [(i, v.tolist(), i % 2) for i, v in enumerate(m)]
    u = m / np.maximum(1e-9, np.linalg.norm(m, axis=1, keepdims=True))
    links = {(i, j) for i in range(len(m)) for j in range(i + 1, len(m)) if i % 2 == j % 2 and u[i] @ u[j] >= 0.9}
    got = {r.id: r.accepted for r in accepted_in_turn(spark.createDataFrame([*rows, (900, None, 0)], "id long, embedding array<double>, part int"), 0.9, "part").collect()}
    taken = _in_turn(range(len(m)), links)
    assert len(links) > 30 and {i for i, ok in got.items() if ok} == taken and set(got) == set(range(len(m)))


def test_concepts_merge_by_vector(spark, tmp_path):
    rows = [
        (5, 1, "Bond yield", "how a bond pays and what it pays", ["b", "a", None], [3, 1], T0), (2, 1, "Bond Yield", "How a bond pays, and what it pays!", ["a", "c"], [1, 7], T0),
        (9, 1, "Equity", "shares of a company", None, None, T0), (3, 2, "Bond yield", "how a bond pays and what it pays", ["z"], [9], T0), (2, 1, "old", "old text", ["old"], [4], T0 - dt.timedelta(1)),
    ]
    df = spark.createDataFrame(rows, "concept_id long, course_id long, title string, description string, keywords array<string>, source_pages array<int>, updated_at timestamp")
    df.write.parquet(f"{tmp_path}/concept_drafts.parquet")
    got = {r.concept_id: (r.drafts, r.keywords, r.pages) for r in merged_concepts(spark, str(tmp_path)).collect()}
    assert got == {2: (2, "a|c|b", "1|7|3"), 9: (1, "", ""), 3: (1, "z", "9")}


def test_windows_of_time(spark, tmp_path):
    log = [(1, "u", 10, 1, 0.0, T0), (2, "u", 11, 1, 0.5, T0 - dt.timedelta(days=4)), (3, "v", 12, 2, 1.0, T0 - dt.timedelta(days=9)), (1, "u", 10, 1, 0.0, T0), (4, None, 12, 2, 1.0, T0)]
    spark.createDataFrame(log, "attempt_id long, user_id string, question_id long, concept_id long, theta_after double, created_at timestamp").write.parquet(f"{tmp_path}/attempt_outcomes.parquet")
    bank = [(10, 1, 7, 1), (11, 1, None, 1), (12, 2, 8, 1), (13, 2, 8, 2), (14, None, 8, 3), (13, 2, 8, 2)]
    spark.createDataFrame(bank, "question_id long, concept_id long, case_group_id long, case_position int").write.parquet(f"{tmp_path}/questions.parquet")
    assert {tuple(r) for r in eligible_counts(spark, str(tmp_path)).collect()} == {("u", 1, 2, 1), ("v", 2, 2, 2)}
    got = [(r.user_id, r.case_group_id, r.concepts, r.place) for r in open_caselets(spark, str(tmp_path)).collect()]
    assert got == [("v", 8, 1, 1)]


def test_json_schema_and_settings(spark):
    schema = {"type": "object", "required": ["k"], "properties": {"k": {"type": ["integer", "null"]}, "xs": {"type": "array", "items": {"enum": ["a", "b"]}}}}
    assert schema_faults({"k": 1, "xs": ["a"]}, schema) == [] and schema_faults({"k": None}, schema) == []
    assert schema_faults({"k": True, "xs": ["c"]}, schema) == ["$.k: not integer or null", "$.xs[0]: not in enum"] and schema_faults([], schema) == ["$: not object"] and schema_faults({}, schema) == ["$: no k"]
    df = spark.createDataFrame([('{"k": 1, "exam": {"n": 5}}',), ('{"n": 7}',), ("nope",), (None,)], "t string")
    got = df.select(faults_of(schema)("t").alias("f"), setting(F.col("t"), "$.exam.n", "$.n", default=9).alias("n")).collect()
    assert [r.f for r in got] == [[], ["$: no k"], ["$: no JSON"], None] and [r.n for r in got] == [5.0, 7.0, 9.0, 9.0]


def test_card_factors(spark):
    got = [r[0] for r in spark.createDataFrame([(1,), (2,), (3,), (4,), (None,)], "g int").select(card_factor(F.col("g"))).collect()]
    assert got[:3] == pytest.approx([0.35 / 1.6, 1.56, 1.8]) and got[3:] == [None, None]


def test_links_within_small_parts_are_exact(spark, monkeypatch):
    """The plan follows the largest part, not all rows: 600 rows in parts of 12 are compared all with all, even where 600 would have tables of low recall."""
    monkeypatch.setattr(vectors, "COPY_COST", 30)
    rng = np.random.default_rng(5)
    m = np.repeat(rng.standard_normal((150, 16)), 4, axis=0) + 0.35 * rng.standard_normal((600, 16))
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    want = {(i, j) for i, j in zip(*(x.tolist() for x in np.nonzero(np.triu(u @ u.T >= 0.9, 1)))) if i // 12 == j // 12}
    rows = spark.createDataFrame([(i, v.tolist(), i // 12) for i, v in enumerate(m)], "id long, embedding array<double>, part int")
    assert vectors.table_plan(600, 0.9, 0.3)[0] > 0
    for block in (2048, 5):
        assert {(r.u, r.v) for r in near_links(rows, 0.9, "part", recall=0.3, block=block).collect()} == want
    assert len(want) > 200


def test_links_at_the_threshold_by_the_formula_of_the_sql(spark):
    """Cosines of counts that are the threshold but for rounding: dot / (length * length) decides."""
    over = [3.0, 1.0, 2.0, 2.0, 1.0, 2.0, 3.0, 2.0], [2.0, 2.0, 1.0, 1.0, 2.0, 1.0, 3.0, 1.0]
    under = [0.0, 0.0, 2.0, 3.0, 1.0, 1.0, 2.0, 1.0], [1.0, 0.0, 1.0, 3.0, 2.0, 1.0, 2.0, 0.0]
    cos = [np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b)) for a, b in (over, under)]
    assert cos[0] >= 0.9 > cos[1] and abs(cos[0] - cos[1]) < 1e-9
    rows = spark.createDataFrame([(k, v, k // 2) for k, v in enumerate([*over, *under])], "id long, embedding array<double>, part int")
    assert [(r.u, r.v) for r in near_links(rows, 0.9, "part").collect()] == [(0, 1)]


def test_runs_of_words_are_not_broadcast(spark):
    """Exploded runs are far larger than estimated; their join takes no broadcast."""
    from gradewright.plans.text import bank_contamination

    plan = bank_contamination(spark, "/root/testdata/sf0.01")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
