import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from gradewright.operators.practice import break_cycles, nearest, ramp, ring_groups, token_batches
from gradewright.plans.practice import concept_quotas

T0 = dt.datetime(2030, 1, 1)


def _acyclic(edges):
    left = set(edges)
    while left:
        keep = {(a, b) for a, b in left if any(x == b for x, _ in left)}
        if keep == left:
            return False
        left = keep
    return True


def _one_rule(edges):
    """Brute force: links into the smallest node of each tangle go, tangles found by reachability."""
    edges = {(a, b) for a, b in edges if a != b}
    work, gone = set(edges), set()
    while True:
        reach = {n: {b for a, b in work if a == n} for e in work for n in e}
        for _ in range(len(reach)):
            reach = {n: r | {y for x in r for y in reach[x]} for n, r in reach.items()}
        tangles = {n: frozenset(x for x in r if n in reach[x]) | {n} for n, r in reach.items() if n in r}
        cut = {(a, b) for a, b in work if a in tangles and tangles[a] == tangles.get(b) and b == min(tangles[a])}
        if not cut:
            return edges - gone
        gone |= cut
        work -= cut


def test_break_cycles(spark):
    rng = random.Random(4)
    edges = {(rng.randrange(40), rng.randrange(40)) for _ in range(70)} | {(100 + i, 101 + i) for i in range(20)}
    df = spark.createDataFrame([*edges, (None, 1), (3, 3), next(iter(edges))], "src long, dst long")
    results = []
    for limit in (100_000, 2):
        got = {tuple(r) for r in break_cycles(df, limit).collect()}
        assert got <= edges and _acyclic(got) and {(100 + i, 101 + i) for i in range(20)} <= got
        results.append(got)
    assert results[0] == results[1] == _one_rule(edges)
    assert not _acyclic({e for e in edges if e[0] != e[1]})
    ring = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1)], "src long, dst long")
    assert {tuple(r) for r in break_cycles(ring).collect()} == {(1, 2), (2, 3), (4, 1)}
    assert break_cycles(ring.limit(0)).count() == 0


def test_nearest_against_brute_force(spark):
    rng = random.Random(1)
    wants = [(rng.randrange(4), f"w{i}", rng.choice([None, rng.randrange(-20, 20) / 4])) for i in range(200)]
    offers = [(rng.randrange(3), i, rng.choice([None, rng.randrange(-20, 20) / 2])) for i in range(50)]
    want = {}
    for k, w, t in wants:
        near = min(((abs(v - t), v, o) for kk, o, v in offers if kk == k and v is not None), default=None) if t is not None else None
        if near:
            want[k, w] = (near[2], near[0])
    got = nearest(spark.createDataFrame(wants, "k long, want_id string, target double"), spark.createDataFrame(offers, "k long, offer_id long, value double"), "k")
    assert {(r.k, r.want_id): (r.offer_id, r.gap) for r in got.collect()} == want


def test_token_batches(spark):
    rows = [(1, i, i, n) for i, n in enumerate([30, 50, 40, 200, 10, None, 90])] + [(2, 0, 9, 5)]
    got = {(r.grp, r.id): r.batch for r in token_batches(spark.createDataFrame(rows, "grp long, pos long, id long, tokens long"), 100).collect()}
    assert got == {(1, 0): 0, (1, 1): 0, (1, 2): 1, (1, 3): 2, (1, 4): 3, (1, 5): 3, (1, 6): 3, (2, 9): 0}


def test_ramp_alternates_chapters(spark):
    rng = random.Random(2)
    rows = [(g, g * 100 + i, rng.randrange(4), rng.randrange(1, 4)) for g in (1, 2) for i in range(30)] + [(3, 1, 7, 1), (3, 2, 7, 2), (3, 3, 7, 1)]
    got = ramp(spark.createDataFrame(rows, "g long, id long, chapter long, difficulty int"), "g").collect()
    chapter = {i: c for _, i, c, _ in rows}
    for g in (1, 2):
        ids = [r.id for r in sorted((r for r in got if r.g == g), key=lambda r: r.place)]
        assert sorted(ids) == sorted(i for gg, i, _, _ in rows if gg == g)
        repeats = [k for k, (a, b) in enumerate(zip(ids, ids[1:])) if chapter[a] == chapter[b]]
        assert all(len({chapter[i] for i in ids[k + 1:]}) == 1 for k in repeats)
    assert [r.id for r in sorted((r for r in got if r.g == 3), key=lambda r: r.place)] == [1, 3, 2]


def test_ring_groups(spark):
    rows = [(1, i) for i in range(10)] + [(2, i) for i in range(3)]
    got = ring_groups(spark.createDataFrame(rows, "g long, id long"), "g", [F.col("id")]).collect()
    rings = {}
    for r in sorted(got, key=lambda r: (r.g, r.ring, r.place)):
        rings.setdefault((r.g, r.ring), []).append(r.id)
    assert rings == {(1, 0): [0, 1, 2, 3], (1, 1): [4, 5, 6, 7], (1, 2): [8, 9, 0, 1], (2, 0): [0, 1, 2]}


@pytest.mark.parametrize("n,floor", [(20, 3), (666, 3), (667, 0), (700, 0), (2500, 0)])
def test_quotas_of_large_courses(spark, tmp_path, n, floor):
    spark.createDataFrame([(i, 5, T0) for i in range(n)] + [(9_000, 6, T0)], "concept_id long, course_id long, updated_at timestamp").write.parquet(f"{tmp_path}/concept_drafts.parquet")
    theta = [(i, i % 3 - 2.0) for i in range(0, n, 2)]
    spark.createDataFrame([(i, "u", i, t, T0) for i, t in theta], "attempt_id long, user_id string, concept_id long, theta_after double, created_at timestamp").write.parquet(f"{tmp_path}/attempt_outcomes.parquet")
    got = {(r.course_id, r.concept_id): r.quota for r in concept_quotas(spark, str(tmp_path)).collect()}
    mastery = dict((i, 1 / (1 + 2.718281828459045 ** (0.3 - t))) for i, t in theta)
    w = [round(1 - mastery.get(i, 0.0), 6) for i in range(n)]
    rest = 2000 - floor * n
    share = [round(x / sum(w) * rest, 9) for x in w]
    up = sorted(range(n), key=lambda i: (-round(share[i] - int(share[i]), 6), i))[: rest - sum(map(int, share))]
    assert got == {(5, i): floor + int(share[i]) + (i in set(up)) for i in range(n)} | {(6, 9_000): 2000}
