import random

from gradewright.llm.spans import SharedSpans

K = 5


def _brute(records, k):
    words = {(t, i): x.split() for t, i, x in {(t, i): (t, i, x) for t, i, x in records if x}.values()}
    where = {}
    for key, w in words.items():
        for a in range(len(w) - k + 1):
            where.setdefault(tuple(w[a: a + k]), set()).add(key)
    out = set()
    for (t, i), w in words.items():
        flags = [False] * len(w)
        for a in range(len(w) - k + 1):
            if len(where[tuple(w[a: a + k])]) > 1:
                flags[a: a + k] = [True] * k
        a = None
        for p, f in enumerate(flags + [False]):
            if f and a is None:
                a = p
            elif not f and a is not None:
                out.add((t, i, a, p - 1))
                a = None
    return out


def _records(seed, n=60):
    rng = random.Random(seed)
    passages = [[f"w{rng.randrange(30)}" for _ in range(rng.randrange(3, 25))] for _ in range(8)]
    out = []
    for i in range(n):
        w = []
        for _ in range(rng.randrange(1, 5)):
            w += [f"x{rng.randrange(400)}" for _ in range(rng.randrange(0, 8))]
            if rng.random() < 0.6:
                p = rng.choice(passages)
                a = rng.randrange(len(p))
                w += p[a: a + rng.randrange(1, 25)]
        out.append((rng.choice("ab"), i, " ".join(w) if rng.random() < 0.7 else " \n".join(w)))
    return out


def test_against_brute_force(spark):
    for seed in range(3):
        rows = _records(seed)
        same = ("a", 900, "one two three four five six"), ("b", 900, "one two three four five six"), ("b", 901, "one two three four")
        rows += [*same, ("a", 902, "q " + same[0][2] + " r"), ("a", 903, None), ("a", 904, ""), ("b", 905, "  \n ")]
        rows += [("a", 906, same[0][2])] * 2 + [("c", 907, " ".join(["la"] * 40)), ("c", 908, " ".join(["la"] * 7))]
        df = spark.createDataFrame(rows, "rec_table string, rec_id long, text string").selectExpr("*", "1 AS rid", "'x' AS h")
        got = {tuple(r) for r in SharedSpans(df, K).stretches().collect()}
        assert got == _brute(rows, K)


def test_one_record_shares_nothing_with_itself(spark):
    df = spark.createDataFrame([("a", 1, "a b c d e a b c d e a b c d e")], "rec_table string, rec_id long, text string")
    assert SharedSpans(df, K).stretches().count() == 0


def test_share_and_passages(spark):
    long_text = " ".join(f"w{i}" for i in range(20_000))
    rows = [("a", 1, "p q " + "a b c d e f"), ("a", 2, "a b c d e f r"), ("a", 3, None), ("b", 4, long_text), ("b", 5, long_text + " end"), ("b", 6, "")]
    spans = SharedSpans(spark.createDataFrame(rows, "rec_table string, rec_id long, text string"), K)
    got = {r.rec_id: (r.n_words, r.shared_words, r.share) for r in spans.share().collect()}
    assert got == {1: (8, 6, 0.75), 2: (7, 6, 6 / 7), 4: (20_000, 20_000, 1.0), 5: (20_001, 20_000, 20_000 / 20_001), 6: (0, 0, None)}
    assert sorted((r.n_texts, r.n_words) for r in spans.passages().collect()) == [(2, 6), (2, 20_000)]


def test_empty_table(spark):
    spans = SharedSpans(spark.createDataFrame([], "rec_table string, rec_id long, text string"))
    assert spans.stretches().count() == 0 and spans.share().count() == 0
