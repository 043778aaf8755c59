import random

import pytest

from gradewright.operators.graph import connected_components
from gradewright.operators.hierarchy import descendants, hierarchy, latest_rows, prerequisite_parents


def _components(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(root)}


@pytest.mark.parametrize("few", [400_000, 3, 0])  # 3 and 0: by contraction
def test_components_match_union_find(spark, few):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(60)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(40)] + [(300, 300), (301, 302), (302, 301)]
    df = spark.createDataFrame(edges + [(None, 4), (5, None)], "src long, dst long")
    got = {r.node: r.component for r in connected_components(df, few_edges=few).collect()}
    assert got == _components(edges)


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def _brute(parent):
    out = {}
    for i in parent:
        seen, x = [], i
        while x is not None and x in parent and x not in seen:
            seen.append(x)
            x = parent[x]
        if x is None or x not in parent:
            out[i] = ("tree", seen[-1], len(seen) - 1, seen[::-1])
        else:
            ring = seen[seen.index(x):]
            low = min(ring)
            out[i] = ("cycle", low, -1, []) if i in ring else ("below_cycle", low, -1, seen[: seen.index(x)][::-1])
    return out


@pytest.mark.parametrize("limit", [200_000, 3])  # 3: larger components go by path doubling
def test_hierarchy_against_brute_force(spark, limit):
    rng = random.Random(5)
    parent = {i: rng.choice([None, rng.randrange(60), rng.randrange(80)]) for i in range(60)}
    parent |= {100 + i: 99 + i for i in range(1, 30)} | {100: None, 200: 201, 201: 202, 202: 200, 203: 200, 204: 203, 210: 210}
    rows = list(parent.items())
    df = spark.createDataFrame(rows + rows[:5] + [(None, 3)], "id long, parent long").selectExpr("id", "parent", "1 AS path", "'x' AS root")
    got = {r.id: (r.node_state, r.root, r.depth, list(r.path)) for r in hierarchy(df, max_component=limit, nodes_per_task=7).collect()}
    assert got == _brute(parent)
    back = {r.id for r in hierarchy(df, max_component=limit).filter("back_edge").collect()}
    assert back == {i for i, (s, low, *_ ) in got.items() if s == "cycle" and parent[i] == low}


def test_descendants(spark):
    df = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 1)], "id long, parent long")
    got = {tuple(r) for r in descendants(hierarchy(df)).collect()}
    assert got == {(1, 2, 1), (1, 3, 2), (1, 4, 1), (2, 3, 1)}


def test_empty_hierarchy(spark):
    assert hierarchy(spark.createDataFrame([], "id long, parent long")).count() == 0


def test_parents_resolve_to_another_draft(spark):
    rows = [(1, 9, "A  b", ["nothing", None, " "]), (2, 9, "a B ", ["a b"]), (3, 9, "c", ["x", " A B"]), (4, 8, "d", ["c"]), (5, 9, None, None)]
    df = spark.createDataFrame(rows, "concept_id long, course_id long, title string, prerequisites array<string>")
    got = {r.id: r.parent for r in prerequisite_parents(df).collect()}
    assert got == {1: None, 2: 1, 3: 1, 4: None, 5: None}


def test_latest_rows(spark):
    df = spark.createDataFrame([(1, 5, "a"), (1, 7, "b"), (1, 7, "c"), (None, 1, "z")], "k long, t long, v string")
    assert [tuple(r) for r in latest_rows(df, "k", "t").collect()] == [(1, 7, "c")]
