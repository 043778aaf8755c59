import math
import random
import re

import numpy as np

from gradewright.llm.leakage import align, leaks
from gradewright.llm.ranking import rank_questions

_SCHEMA = "attempt_id long, user_id string, question_id long, correct boolean, theta_before double, q_rating_before double"


def _attempts(seed=1, users=60, questions=40, n=6000):
    rng = random.Random(seed)
    able = {u: rng.gauss(0, 1) for u in range(users)}
    hard = {q: rng.gauss(0, 1) for q in range(questions)}
    rows = []
    for i in range(n):
        u = rng.randrange(users)
        q = min(questions - 1, int(rng.expovariate(0.1)))
        if q % 5 == 0 and able[u] < 0:  # some questions only meet strong learners
            continue
        rows.append((i, f"u{u}", q, rng.random() < 1 / (1 + math.exp(hard[q] - able[u])), able[u] + rng.gauss(0, 1), hard[q] + rng.gauss(0, 0.5)))
    return rows, hard


def test_ranking_recovers_strengths(spark):
    rows, hard = _attempts()
    df = spark.createDataFrame(rows + rows[:50], _SCHEMA).selectExpr("*", "1 AS key", "2 AS level")
    got = {r.question_id: r for r in rank_questions(df).collect()}
    many = [q for q, r in got.items() if r.games >= 60]
    x, y = np.array([hard[q] for q in many]), np.array([got[q].strength for q in many])
    assert np.corrcoef(x, y)[0, 1] > 0.9
    inside = [abs(got[q].strength - hard[q] - (y - x).mean()) < 3 * got[q].se for q in many]
    assert np.mean(inside) > 0.9
    order = sorted(got.values(), key=lambda r: (-r.strength, r.question_id))
    assert [r["rank"] for r in order] == list(range(1, len(order) + 1)) and len({r.component for r in order}) == 1
    assert sum(r.games for r in order) == len(rows)


def test_few_contests_stay_near_the_middle_with_wide_errors(spark):
    rows = [(i, f"u{i % 7}", 1, i % 2 == 0, 0.0, 0.0) for i in range(200)] + [(900, "u1", 2, False, 0.0, 0.0)]
    got = {r.question_id: r for r in rank_questions(spark.createDataFrame(rows, _SCHEMA)).collect()}
    assert all(r.last_change < 0.01 for r in got.values())
    assert got[2].one_sided and not got[1].one_sided and 0 < got[2].strength < 2 and got[2].se > 3 * got[1].se


def test_one_sided_players_are_fitted_to_the_end(spark):
    rows = [(i, f"u{i % 50}", 1, False, 0.0, 0.0) for i in range(4000)] + [(5000 + i, f"u{i % 50}", 2 + i % 3, i % 2 == 0, 0.0, 0.0) for i in range(3000)]
    got = {r.question_id: r for r in rank_questions(spark.createDataFrame(rows, _SCHEMA)).collect()}
    assert got[1].rank == 1 and got[1].one_sided and got[1].strength > 3 and got[1].last_change < 0.01


def test_components_nulls_and_empty(spark):
    rows = [(1, "a", 1, True, None, None), (2, "a", 2, False, None, None), (3, "b", 3, True, 0.5, None), (4, None, 4, True, 0.51, None), (5, None, 5, False, 0.49, 0.1), (6, None, 6, True, None, None), (7, "a", None, True, None, None), (8, "a", 8, None, None, None), (None, "a", 9, True, None, None)]
    got = {r.question_id: r.component for r in rank_questions(spark.createDataFrame(rows, _SCHEMA)).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6} and got[1] == got[2] and got[4] == got[5] and len(set(got.values())) == 4
    assert rank_questions(spark.createDataFrame([], _SCHEMA)).count() == 0


def test_alignment():
    item = np.arange(20)
    assert align(item, item) == (40, 20, 20)
    edited = np.concatenate([item[:8], [99], item[8:12], item[13:]])  # one word put in, one left out
    score, matched, run = align(edited, item)
    assert score == 38 - 2 and run == 8 and matched == 19  # 8 + 4 + 7
    assert align(np.full(5, -1), item) == (0, 0, 0)


def _words(t):
    return re.findall("[a-z0-9]+", t.lower())


def _runs(t):
    w = _words(t)
    return {tuple(w[a: a + 12]) for a in range(len(w) - 11)}


def test_leaks_against_brute_force(spark):
    rng = random.Random(4)
    vocab = [f"v{i}" for i in range(400)]
    common = "so that all clients can compare the offers"
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([3, 8, 12, 15, 40]))) + (" " + common if i % 3 == 0 else "")) for i in range(25)]
    docs = []
    for i in range(120):
        w = [rng.choice(vocab) for _ in range(rng.randrange(0, 60))] + common.split()
        if i % 3 == 0:
            own = _words(rng.choice(items)[1])
            a = rng.randrange(len(own))
            part = own[a: a + rng.randrange(1, 40)]
            at = rng.randrange(len(w) + 1)
            w[at:at] = part
        docs.append((i, " - ".join(w).title() if i % 2 else " ".join(w), "x"))
    docs += [(500, None, "x"), (501, "", "x"), docs[0]]
    df = spark.createDataFrame(docs, "doc_id long, text string, seed string")
    it = spark.createDataFrame(items + [(90, None), (91, "")] + items[:2], "item_id long, text string")
    for block in (200_000, 100):
        got = {(r.doc_id, r.item_id) for r in leaks(df, it, block_words=block).filter("longest_run >= 12").collect()}
        assert got == {(d, i) for d, t, _ in docs if t for i, x in items if _runs(t) & _runs(x)}


def test_edited_copies_are_found(spark):
    rng = random.Random(9)
    item = [f"v{rng.randrange(500)}" for _ in range(40)]
    edited = [w if k % 9 else "other" for k, w in enumerate(item)]
    half = item[:10] + [f"z{k}" for k in range(30)]
    df = spark.createDataFrame([(1, " ".join(["pad"] * 50 + edited + ["pad"] * 50)), (2, " ".join(half)), (3, "nothing here")], "doc_id long, text string")
    got = leaks(df, spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")).collect()
    assert [(r.doc_id, r.item_id) for r in got] == [(1, 7)] and got[0].longest_run < 12 and got[0].share >= 0.6


def test_edited_copies_in_a_third_of_the_documents_are_found(spark):
    rng = random.Random(9)
    item = [f"v{k}" for k in range(40)]
    copies = [" ".join(["pad"] * rng.randrange(9) + [w if k % 9 else "other" for k, w in enumerate(item)]) for _ in range(30)]
    rare = " ".join(w if k % 9 != 4 else "other" for k, w in enumerate(item))  # makes the rarest seed of a window one that the copies lack
    rest = [" ".join(f"z{rng.randrange(90)}" for _ in range(50)) for _ in range(60)] + [" ".join(item[:10])]
    df = spark.createDataFrame(list(enumerate([*copies, rare, *rest])), "doc_id long, text string")
    got = leaks(df, spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")).collect()
    assert {r.doc_id for r in got} == set(range(31)) and all(r.longest_run < 12 and r.share >= 0.6 for r in got)


def test_recall_of_edited_copies_by_rate_and_number(spark):
    """Recall among the copies that reach the score: at every rate of edits, however many documents carry them."""
    rng = random.Random(12)
    vocab = [f"v{i}" for i in range(600)]
    items = {i: [rng.choice(vocab) for _ in range(rng.randrange(30, 70))] for i in range(9)}
    docs, planted = [], {}
    for rate in (0.1, 0.2, 0.25):
        for many, own in ((1, (0, 1, 2)), (3, (3, 4, 5)), (50, (6, 7, 8))):
            for item in own:
                for _ in range(many):
                    copy = []
                    for w in items[item]:
                        u = rng.random() / rate
                        copy += [w] if u > 1 else [rng.choice(vocab)] if u < 0.6 else [] if u < 0.8 else [w, rng.choice(vocab)]
                    text = [rng.choice(vocab) for _ in range(rng.randrange(80))] + copy + [rng.choice(vocab) for _ in range(30)]
                    number = {w: k for k, w in enumerate(vocab)}
                    if align(np.array([number[w] for w in text]), np.array([number[w] for w in items[item]]))[0] >= 1.2 * len(items[item]):
                        planted.setdefault((rate, many), set()).add((len(docs), item))
                    docs.append((len(docs), " ".join(text)))
    got = {(r.doc_id, r.item_id) for r in leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")).collect()}
    assert len(planted) == 9
    for case, pairs in planted.items():
        assert len(pairs & got) >= 0.9 * len(pairs), case


def test_no_documents_or_items(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    one = spark.createDataFrame([(1, " ".join("abcdefghijklmnop"))], "doc_id long, text string")
    assert leaks(docs, one.withColumnRenamed("doc_id", "item_id")).count() == 0 and leaks(one, items).count() == 0
