import random
import re

import pytest

from gradewright.llm.consolidate import consolidate, draft_matches
from gradewright.llm.neardup import NearDuplicates


def _sets(rows):
    out = {}
    for s, i, t in rows:
        w = re.findall("[a-z0-9]+", (t or "").lower())
        g = {tuple(w[a: a + 3]) for a in range(len(w) - 2)}
        if g:
            out[s, i] = g
    return out


def _brute(rows):
    sets = sorted(_sets(rows).items())
    return {(s, i, j) for n, ((s, i), a) in enumerate(sets) for (t, j), b in sets[n + 1:] if s == t and len(a & b) / len(a | b) >= 0.6}


def _rows(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)]
    out, i = [], 0
    for _ in range(25):
        base = [rng.choice(vocab) for _ in range(rng.choice([3, 4, 8, 20, 40, 90]))]
        for _ in range(rng.randrange(1, 5)):
            w = base[:]
            for _ in range(rng.randrange(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            out.append((rng.choice(["q", "c"]), i, ", ".join(w).upper()))
            i += 1
    common = "a b c d e f g h"
    out += [("q", 500 + k, common + f" t{k}") for k in range(14)] + [("q", 600, common), ("q", 601, common.upper() + "!"), ("q", 602, common)]
    return out + [("q", 700, None), ("q", 701, ""), ("q", 702, "two words"), ("q", 703, "a b c"), ("q", 704, "A b-c"), ("q", 600, common)]


@pytest.mark.parametrize("coverings", [((1024, 64), (8192, 512)), ((16, 2), (64, 3))])  # small ones send records to the last stage
def test_pairs_against_brute_force(spark, coverings):
    for seed in range(2):
        rows = _rows(seed)
        df = spark.createDataFrame(rows, "scope string, id long, text string").selectExpr("*", "1 AS n", "2 AS rid")
        found = NearDuplicates(df, coverings=coverings, block=4, few=3)
        got = [tuple(r) for r in found.pairs(block=2).collect()]
        assert len(got) == len(set(got)) and set(got) == _brute(rows)


def test_copy_groups_have_one_form_at_every_size(spark):
    rows = [("q", i, "same words in this very text") for i in range(30)] + [("q", 99, "same words in this very text ok"), ("c", 3, "same words in this very text")]
    for block in (512, 7):
        pairs = [tuple(r) for r in NearDuplicates(spark.createDataFrame(rows, "scope string, id long, text string")).pairs(block).collect()]
        assert len(pairs) == len(set(pairs)) and set(pairs) == {("q", i, j) for i in range(30) for j in [*range(i + 1, 30), 99]}


def test_groups_and_links(spark):
    rows = [("q", 5, "a b c d e f g"), ("q", 2, "a b c d e f g"), ("q", 9, "a b c d e f g h"), ("q", 4, "x y z"), ("c", 5, "a b c d e f g")]
    got = {(r.scope, r.id): (r.group_id, r.links) for r in NearDuplicates(spark.createDataFrame(rows, "scope string, id long, text string")).groups().collect()}
    assert got == {("q", 5): (2, 1), ("q", 2): (2, 1), ("q", 9): (2, 1), ("q", 4): (4, 0), ("c", 5): (5, 0)}


def test_no_records(spark):
    assert NearDuplicates(spark.createDataFrame([], "scope string, id long, text string")).pairs().count() == 0


def _components(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(root)}


@pytest.mark.parametrize("frontiers", [30, 2])  # 2: the first component is contracted, not peeled
def test_consolidate_against_union_find(spark, frontiers):
    rng = random.Random(8)
    edges = [(1000, 1000 + i) for i in range(1, 40)] + [(1000 + i, 1001 + i) for i in range(40, 70)] + [(1039, 1041)]
    edges += [(i, i + 1) for i in range(0, 50)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)] + [(400, 400)]
    df = spark.createDataFrame(edges + edges[:9] + [(None, 1), (2, None)], "src long, dst long")
    got = [(r.node, r.group_id) for r in consolidate(df, frontiers).collect()]
    assert len(got) == len(dict(got)) and dict(got) == _components(edges)


def test_consolidate_nothing(spark):
    assert consolidate(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_draft_matches_close_like_all_pairs(spark):
    rng = random.Random(6)
    rows = []
    for i in range(80):
        rows.append((rng.randrange(2), i, rng.choice([None, f"T-{rng.randrange(40)}", f"t {rng.randrange(40)}!"]),
                     rng.choice([None, [], [rng.choice([" A", "b", "B ", "c", "d", "e", None, ""]) for _ in range(5)]]), rng.choice([None, [], [rng.randrange(12), None, rng.randrange(12)]])))
    form = lambda t: None if t is None else re.sub("[^a-z0-9]", "", t.lower())
    words = lambda k: {x.strip().lower() for x in k or [] if x and x.strip()}
    edges = [
        (a[1], b[1]) for n, a in enumerate(rows) for b in rows[n + 1:]
        if a[0] == b[0] and (form(a[2]) is not None and form(a[2]) == form(b[2]) or {p for p in a[4] or [] if p is not None} & {p for p in b[4] or [] if p is not None} and len(words(a[3]) & words(b[3])) >= 2)
    ]
    df = spark.createDataFrame(rows, "course_id long, concept_id long, title string, keywords array<string>, source_pages array<int>")
    got = {r.node: r.group_id for r in consolidate(draft_matches(df)).collect()}
    assert got == _components(edges)
