import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradewright.functions import text as X
from gradewright.operators.chunking import Limits, _Source, _TOKEN, pack_pages, units_of_page
from gradewright.operators.vectors import dimension_rejects, near_classes, near_links, search, table_plan
from gradewright.skew import lookup


def _one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x"))).first()[0]


def test_text_expressions(spark):
    assert _one(spark, "Crédit: 5% of_it", X.token_count) == 5
    assert _one(spark, None, X.token_count) is None
    assert _one(spark, "A-b 12\nc", X.words) == ["a", "b", "12", "c"]
    assert _one(spark, "trans-\nfer and X-\nY", X.dehyphenate) == "transfer and X-\nY"
    assert _one(spark, "  Page  12 of 30 ", X.chrome_form) == "page ## of ##"
    assert _one(spark, "One. Two!  Three?", X.sentences) == ["One.", "Two!", "Three?"]
    assert _one(spark, ["a ", None, "b"], X.table_row, "array<string>") == "a |  | b"
    assert _one(spark, [["a", None], None, ["b", "a"]], X.distinct_union, "array<array<string>>") == ["a", "b"]
    assert _one(spark, ["a", "b", "c"], lambda c: X.ngrams(c, 2), "array<string>") == ["a b", "b c"]
    assert _one(spark, ["a"], lambda c: X.ngrams(c, 2), "array<string>") == []
    assert [_one(spark, s, X.line_kind) for s in ("a | b", "Example 1", "text", " ")] == ["table", "example", "prose", None]


def test_units_keep_tables_and_examples_whole():
    text = "One. Two\ngoes on.\nA | B\n1 | 2\nExample 1\nline\n\nAfter."
    assert units_of_page(text) == ["One.", "Two goes on.", "A | B\n1 | 2", "Example 1\nline", "After."]
    assert units_of_page(None) == [] and units_of_page(" \n") == []


def test_packer_bounds_overlap_and_rest():
    rng = random.Random(1)
    units = [" ".join(f"w{rng.randrange(99)}" for _ in range(rng.randrange(5, 60))) for _ in range(400)]
    source, chunks = _Source(Limits()), []
    for i, u in enumerate(units):
        chunks += source.add(i, [u])
    chunks += source.rest()
    n = lambda c: sum(len(_TOKEN.findall(u)) for _, u in c)
    assert [i for c in chunks for i in c] and sorted({p for c in chunks for p, _ in c}) == list(range(400))
    sizes = [n(c) for c in chunks]
    assert max(sizes) <= 1400 and min(sizes[:-1]) >= 300
    for a, b in zip(chunks, chunks[1:]):
        shared = [x for x in b if x in a]
        assert n(shared) <= 135 and b[: len(shared)] == shared


def test_pack_pages_streams_sources(spark):
    sentence = "The trustee reviews the plan every year and reports what has changed since then. "
    rows = [(s, p, sentence * 30) for s in (1, 2) for p in range(8)] + [(3, 1, None), (3, 2, " "), (4, 1, "Short.")]
    got = pack_pages(spark.createDataFrame(rows, "source_id long, page_number int, text string")).collect()
    assert {r.source_id for r in got} == {1, 2, 4}
    one, two = ([(r.chunk_no, r.content, r.page_start, r.page_end) for r in got if r.source_id == s] for s in (1, 2))
    assert one == two and all(r.token_count == len(_TOKEN.findall(r.content)) for r in got)
    assert pack_pages(spark.createDataFrame([], "source_id long, page_number int, text string")).count() == 0


def _vectors(n=300, d=24, seed=4):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n, d))
    twins = base[:60] + 0.15 * rng.standard_normal((60, d))
    return np.vstack([base, twins])


def test_search_is_exact(spark):
    m = _vectors()
    rows = spark.createDataFrame([(i, v.tolist(), "x") for i, v in enumerate(m)] + [(999, None, "x"), (998, [0.0] * 24, "x")], "id long, embedding array<double>, cos string")
    got = search(rows.filter("id % 20 = 0"), rows, 5).collect()
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    for q in range(0, len(m), 20):
        cos = u @ u[q]
        cos[q] = -9
        want = sorted(range(len(m)), key=lambda j: (-cos[j], j))[:5]
        assert [r.id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == want
    assert search(rows.filter("id < 0"), rows, 5).count() == 0


def test_search_within_a_key_and_between_kinds(spark):
    m = _vectors()
    rows = spark.createDataFrame([(i, v.tolist(), i % 3 if i % 11 else None) for i, v in enumerate(m)], "id long, embedding array<double>, part long")
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    got = search(rows.filter("id % 20 = 0"), rows, 4, within="part", same_ids=False).collect()
    for q in range(0, len(m), 20):
        own = [j for j in range(len(m)) if q % 11 and j % 11 and j % 3 == q % 3]
        want = sorted(own, key=lambda j: (-round(float(u[j] @ u[q]), 12), j))[:4]
        assert [r.id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == want


def _planted(n=700, d=32, seed=3):
    """Vectors with partners at cosines from 0.83 to 0.95."""
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n, d))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    extra = []
    for i, v in enumerate(base[:300]):
        w = rng.standard_normal(d)
        w -= (w @ v) * v
        c = 0.831 + 0.12 * i / 300
        extra.append(c * v + (1 - c * c) ** 0.5 * w / np.linalg.norm(w))
    return np.vstack([base, extra])


@pytest.mark.parametrize("bits", [None, 8])
def test_near_links_at_the_registered_threshold(spark, bits):
    """Exact where all are compared with all; with tables, at least the recall asked for less a margin."""
    m = _planted()
    links = {(i, j) for i, j in zip(*(x.tolist() for x in np.nonzero(np.triu(m @ m.T >= 0.83, 1))))}
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)] + [(5000, None), (5001, [0.0] * 32)], "id long, embedding array<double>")
    plan = None if bits is None else (bits, math.ceil(math.log(0.01) / math.log(1 - (1 - math.acos(0.83) / math.pi) ** bits)))
    got = {(r.u, r.v) for r in near_links(df, 0.83, block=128, plan=plan).collect()}
    assert len(links) >= 300 and got <= links and len(got) >= (1 if bits is None else 0.98) * len(links)
    assert table_plan(1000, 0.83, 0.999) == (0, 1) and table_plan(10**9, 0.83, 0.999)[0] > 10


def test_near_classes_and_keys(spark):
    m = _planted(60)
    rows = spark.createDataFrame([(i, v.tolist(), i % 2) for i, v in enumerate(m)], "id long, embedding array<double>, part int")
    got = {r.id: r for r in near_classes(rows, 0.83, within="part").collect()}
    want = {(i, j) for i, j in zip(*np.nonzero(np.triu(m @ m.T >= 0.83, 1))) if i % 2 == j % 2}
    assert len(got) == len(m) and all(got[i].class_id == got[j].class_id for i, j in want) and sum(r.links for r in got.values()) == 2 * len(want)


def test_dimension_rejects(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (3, [1.0]), (4, [1.0, None]), (5, [1.0, float("nan")])], "id long, embedding array<double>")
    assert {r.id: r.reason for r in dimension_rejects(rows, 2).collect()} == {2: "missing", 3: "dimension", 4: "value", 5: "value"}


def test_lookup_splits_hot_keys(spark):
    rows = spark.createDataFrame([(1, i) for i in range(3000)] + [(i, i) for i in range(2, 50)] + [(None, 1)], "k long, v long")
    keyed = spark.createDataFrame([(i, i * 10, 3000 if i == 1 else 1) for i in range(1, 40)], "k long, w long, cnt long")
    got = lookup(rows, keyed, "k")
    assert got.count() == 3000 + 38 and got.filter("w <> k * 10").count() == 0
    assert lookup(rows, keyed.limit(0), "k").count() == 0
