import random

from gradewright.llm.scans import ScannedPages, _fold, edge_form, readings, repaired_number
from gradewright.llm.spam import spam_scores

_SENTENCES = [
    "The trustee has to review the municipal covenant before the premium is paid.", "Every auditor learns to compare the dividend-paying schedule with the annual premium.",
    "An officer may justify the municipal schedule although the covenant remains uncertain.", "Costs are charged on the annual covenant, which the auditor chose to review.",
    "The premium of the dividend-paying covenant should rise near 14.23% before 2031.", "Learners often confuse the annual schedule with the municipal premium of 3,512 crowns.",
]


def _book(pages=30, seed=1):
    rng = random.Random(seed)
    out = []
    for p in range(1, pages + 1):
        body = [f"According to {rng.choice('BCDFGK')}a{rng.choice('lmnprs')}o{rng.choice('dkntv')}, {s[0].lower()}{s[1:]}" for s in rng.choices(_SENTENCES, k=12)]
        out.append(["Premium Study Guide", "", *body, "", f"- {p + 10} -"])
    return out


def _frame(spark, book, source=1):
    return spark.createDataFrame([(source * 1000 + p, source, p, "\n".join(x)) for p, x in enumerate(book, 1)], "page_id long, source_id long, page_number int, text string")


def _found(pages):
    return {(r.page_id, r.line_no, r.defect): r.repaired for r in pages.defects().collect()}


def test_clean_book_has_only_chrome(spark):
    got = _found(ScannedPages(_frame(spark, _book())))
    assert {k[:2] for k in got} == {(1000 + p, n) for p in range(1, 31) for n in (1, 16)} and {k[2] for k in got} == {"chrome"}


def test_defects_are_found_and_repaired(spark):
    book = _book()
    book[1][0] = "Prernium Study Gu1de"          # a misread running head
    book[2][-1] = "- l3 -"                       # a misread page number
    book[3][4:4] = ["The trustee has to review the mun-", "icipal covenant before the premium is paid."]
    book[4][4:4] = ["Every auditor learns to compare the dividend-", "paying schedule with the annual premium."]
    book[5][4] = "The trustee has to review the municipal covenarit before the prcmium is paid."
    book[6][4] = "The premium should rise near l4.2Z% before 2O31, or Form S2 of 1991."
    book[7][13] = "The trustee has to compare the cov¬"  # goes on on the page after the empty one
    book[8] = ["", ""]
    book[9][2] = "enant with the schedule, although it remains uncertain."
    book[10][5] = "117"                           # a lone number inside the page
    got = _found(ScannedPages(_frame(spark, book)))
    assert got[1002, 1, "chrome"] == "" and got[1003, 16, "chrome"] == ""
    assert got[1004, 5, "broken"] == "municipal" and got[1005, 5, "broken"] == "dividend-paying" and got[1008, 14, "broken"] == "covenant"
    rows = {(r.line_no, r.repaired) for r in ScannedPages(_frame(spark, book)).defects().filter("page_id in (1006, 1007) and defect = 'glyph'").collect()}
    assert rows == {(5, "covenant"), (5, "premium"), (5, "14.22"), (5, "2031")}
    assert not any(k[0] == 1011 and k[1] == 6 for k in got)
    assert sum(k[2] != "chrome" for k in got) == 3 + 4 - 3 or sum(k[2] == "glyph" for k in got) <= 4


def test_paragraphs_read_on(spark):
    book = _book()
    book[3][2:2] = ["The trustee has to review the mun-", "icipal covenarit before the premium is paid.", ""]
    book[7][13] = "The trustee has to compare the cov-"
    book[8][2] = "enant with the schedule, although it remains uncertain."
    got = {(r.page_id, r.paragraph_no): r for r in ScannedPages(_frame(spark, book)).paragraphs().collect()}
    assert got[1004, 0].text == "The trustee has to review the municipal covenant before the premium is paid."
    assert got[1008, 0].text.endswith("compare the covenant") and got[1008, 0].goes_on and got[1009, 0].text.startswith("with the schedule, although")
    assert not any("Study Guide" in r.text or "- 1" in r.text for r in got.values())


def test_nulls_repeats_and_empty(spark):
    base = _frame(spark, _book(8))
    odd = spark.createDataFrame([(5000, 2, 1, None), (5001, 2, 2, ""), (None, 2, 3, "x"), (1001, 1, 1, ""), (5003, 3, None, "a b-\nc")], base.schema)
    got = _found(ScannedPages(base.union(odd).union(base).selectExpr("*", "'x' AS kind", "1 AS n")))
    assert {k[0] for k in got if k[2] == "chrome"} == set(range(1001, 1009))
    none = ScannedPages(base.limit(0))
    assert none.defects().count() == 0 and none.paragraphs().count() == 0


def test_forms():
    assert edge_form("Capita1 Institute 25")[0] == edge_form("Capltal lnstitute 7")[0] and edge_form("- 12 -")[1] == 12 and edge_form("[xiv]")[1:] == (14, True)
    assert _fold("rnodem clean") == _fold("modern dean") and "municipal" in readings("rnunicipal") and "withdrawal" in readings("witbclrawal")
    assert repaired_number("6S1,672", "of") == "651,672" and repaired_number("3.3G%", "near") == "3.36" and repaired_number("S9", "Form") is None and repaired_number("12", "x") is None


_TERMS = ["free pdf", "mock test", "quick cash", "tax saver", "study kit", "broker login", "exam dumps", "credit repair"]


def _prose(rng, n):
    names = ["Fanoley", "Corter", "Oldom", "Zenmon", "Rarix"]
    forms = [
        "The officer wrote to {} about the {} of the {} plan.", "Every auditor trained by {} learns to review the {} before the {} is paid.", "Costs of {} are charged on the {}, which the {} chose to adjust.",
        "Neither the {} nor the {} of the scheme was affected by clause {}.", "To assess a {}, {} first needs to compare the {} with the budget.",
    ]
    nouns = ["ledger", "premium", "covenant", "turnover", "allotment", "escrow", "tranche", "warrant", "dividend", "mandate"]
    return " ".join(rng.choice(forms).format(*[rng.choice(nouns + names) for _ in range(3)]) for _ in range(n))


def test_spam_and_prose_are_told_apart(spark):
    rng = random.Random(2)
    rows = [(i, _prose(rng, rng.randrange(2, 25))) for i in range(300)]
    bad = {
        1000: ", ".join(rng.choice(_TERMS) for _ in range(80)), 1001: " | ".join(rng.choice(_TERMS).title() for _ in range(50)), 1002: "\n".join(f"https://shop.x{i}-deals.example/free-pdf/mock+test?id={i}" for i in range(20)),
        1003: " ".join("free pdf best free pdf best" for _ in range(20)), 1004: " ".join("#" + rng.choice(_TERMS).replace(" ", "") for _ in range(40)), 1005: _prose(rng, 1) + "\n" + "; ".join(rng.choice(_TERMS) for _ in range(90)),
        1006: "\n".join(f"mock test near Place{i}" for i in range(40)),
    }
    good = {
        2000: _prose(rng, 12) + "\nTags: free pdf, mock test, quick cash", 2001: _prose(rng, 3) + "\nPlan | Premium | Rate\n" + "\n".join(f"Fund{i} Growth | {i * 37 % 991} crowns | {i}.3%" for i in range(40)),
        2002: _prose(rng, 14).lower().replace(".", "").replace(",", ""), 2003: "See https://a.example/b/c for more. " + _prose(rng, 10), 2004: _prose(rng, 12).replace("ledger", "premium").replace("covenant", "premium"),
        2005: None, 2006: "", 2007: "Word", 2008: _prose(rng, 4000),
    }
    df = spark.createDataFrame(rows + list(bad.items()) + list(good.items()) + rows[:3], "doc_id long, text string").selectExpr("*", "1 AS n", "'x' AS cell")
    got = {r.doc_id: r for r in spam_scores(df).collect()}
    assert {i for i, r in got.items() if r.spam} == set(bad) and len(got) == 300 + len(bad) + len(good) - 1
    assert got[1002].link_share > 0.9 and got[2006].n_words == 0


_OTHER = {
    "pl": (["Każdy {} musi sprawdzić {} przed końcem roku, a potem zapisać {} w rejestrze.", "Nie wiadomo, czy {} będzie mógł zmienić {} bez zgody {}.", "W umowie z {} zapisano, że {} nie może być niższy niż {}.", "Po co {} ma płacić za {}, skoro {} jest już zamknięty?"],
           ["rachunek", "bilans", "zarządca", "fundusz", "wniosek", "kredyt", "oddział", "termin", "udział", "podatek"]),
    "sv": (["Varje {} måste granska {} innan året är slut och sedan skriva in {} i boken.", "Det är inte klart om {} får ändra {} utan att {} har sagt ja.", "I avtalet med {} står det att {} inte får vara lägre än {}.", "Varför ska {} betala för {} när {} redan är stängd?"],
           ["räkning", "balans", "förvaltare", "fond", "ansökan", "kredit", "avdelning", "tidsfrist", "andel", "skatt"]),
}


def test_shuffled_prose_is_spam_and_languages_without_lists_are_not(spark):
    rng = random.Random(8)
    rows = [(i, _prose(rng, rng.randrange(4, 25))) for i in range(400)]
    for k, (forms, nouns) in enumerate(_OTHER.values()):
        rows += [(1000 * (k + 1) + i, " ".join(rng.choice(forms).format(*rng.sample(nouns, 3)) for _ in range(rng.randrange(4, 15)))) for i in range(100)]
    salad = []
    for i, text in rows[:150]:
        words = text.split()
        rng.shuffle(words)
        salad.append((5000 + i, " ".join(words)))
    got = {r.doc_id: r.spam for r in spam_scores(spark.createDataFrame(rows + salad, "doc_id long, text string")).collect()}
    assert sum(got[i] for i, _ in salad) >= 0.9 * len(salad)
    for start, end in ((0, 1000), (1000, 2000), (2000, 3000)):
        own = [v for i, v in got.items() if start <= i < end]
        assert sum(own) <= 0.02 * len(own)


def test_spam_of_nothing(spark):
    assert spam_scores(spark.createDataFrame([], "doc_id long, text string")).count() == 0
