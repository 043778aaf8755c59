"""Queries on page texts, chunks, drafts and the item bank."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradewright import config as C
from gradewright.functions import text as X
from gradewright.operators.chunking import pack_pages
from gradewright.operators.hierarchy import latest_rows, title_form
from gradewright.plans.learning import questions
from gradewright.skew import lookup
from gradewright.tables import read


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "parsed_pages").dropDuplicates(["page_id"])


def _chunks(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return read(spark, sf_dir, "chunks").select("chunk_id", *columns).dropDuplicates(["chunk_id"])


def _drafts(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return latest_rows(read(spark, sf_dir, "concept_drafts").select("concept_id", "updated_at", *columns), "concept_id", "updated_at")


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every chunk counted anew, beside the stored count."""
    return _chunks(spark, sf_dir, "content", "token_count").select("chunk_id", X.token_count(F.col("content")).cast("long").alias("tokens"), F.col("token_count").alias("stored"))


def chunk_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By course: chunks below and above the size limits, and tokens at the median."""
    sized = _chunks(spark, sf_dir, "course_id", "content").select("course_id", X.token_count(F.col("content")).alias("t"))
    return sized.groupBy("course_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("t") < C.CHUNK_MIN).alias("small"), F.count_if(F.col("t") > C.CHUNK_MAX).alias("large"),
        F.sum("t").cast("long").alias("tokens"), F.percentile("t", F.lit(0.5)).alias("median"),
    )


def dehyphenated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page texts with line-end hyphens between lower-case letters undone, by digest, and how many were."""
    fixed = X.dehyphenate(F.col("text"))
    return _pages(spark, sf_dir).filter("text is not null").select(
        "page_id", F.md5(fixed).alias("digest"), ((F.length("text") - F.length(fixed)) / 2).cast("long").alias("joined")
    )


def page_chrome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edge lines that recur on at least a share of a source's pages, in their normal form."""
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    pages = _pages(spark, sf_dir).filter("text is not null").select("source_id", "page_id", lines.alias("ls")).filter(F.size("ls") > 0)
    ends = F.array(F.struct(F.lit("top").alias("side"), F.element_at("ls", 1).alias("line")), F.struct(F.lit("bottom").alias("side"), F.element_at("ls", -1).alias("line")))
    edges = pages.select("source_id", "page_id", F.explode(ends).alias("e")).select("source_id", "page_id", F.col("e.side").alias("side"), X.chrome_form(F.col("e.line")).alias("form"))
    totals = pages.groupBy("source_id").agg(F.count("*").alias("n"))
    counted = edges.groupBy("source_id", "side", "form").agg(F.count_distinct("page_id").alias("pages"))
    return counted.join(totals, "source_id").filter(F.col("pages") >= F.greatest(F.lit(2), F.floor(F.col("n") * C.CHROME_SHARE))).select("source_id", "side", "form", "pages")


def parse_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By source: pages, pages with enough text, pages read by recognition, the share covered."""
    n = F.length(F.trim(F.coalesce("text", F.lit(""))))
    return _pages(spark, sf_dir).groupBy("source_id").agg(
        F.count("*").alias("pages"), F.count_if(n >= C.MIN_PAGE_CHARS).alias("filled"), F.count_if(F.col("ocr_used")).alias("scanned"),
        F.round(F.avg((n >= C.MIN_PAGE_CHARS).cast("double")), 6).alias("coverage"),
    )


def line_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every chunk by kind."""
    lines = _chunks(spark, sf_dir, "content").select("chunk_id", F.explode(F.split("content", "\n")).alias("line"))
    kinds = lines.select("chunk_id", X.line_kind(F.col("line")).alias("kind")).filter("kind is not null")
    return kinds.groupBy("chunk_id", "kind").agg(F.count("*").alias("n"))


def sentence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of every document, and the length of the longest."""
    s = read(spark, sf_dir, "documents").filter("text is not null").select("doc_id", X.sentences(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").cast("long").alias("sentences"), F.coalesce(F.array_max(F.transform("s", lambda x: F.length(x))), F.lit(0)).cast("long").alias("longest"))


def content_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of texts that several documents have."""
    rows = read(spark, sf_dir, "documents").filter("text is not null and text <> ''").select("doc_id", F.sha2("text", 256).alias("digest"))
    return rows.groupBy("digest").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")).filter("copies > 1")


def bank_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stems that share a run of 8 words with a chunk of their course: the first such run and how many there are."""
    runs = lambda df, *keep: df.select(*keep, F.explode(F.array_distinct(X.ngrams(F.col("w"), C.NGRAM))).alias("gram"))
    # The words are exploded from a stored column: written into the lambda they would be split anew for every run.
    chunk_words = _chunks(spark, sf_dir, "course_id", "content").select("course_id", X.words(F.col("content")).alias("w")).filter(F.size("w") >= C.NGRAM).repartition("course_id", F.hash("w"))
    stem_words = questions(spark, sf_dir, "course_id", "stem").select("question_id", "course_id", X.words(F.col("stem")).alias("w")).filter(F.size("w") >= C.NGRAM).repartition("question_id")
    known = runs(chunk_words, "course_id").groupBy("course_id", "gram").agg(F.count("*").alias("n")).drop("n")
    # Runs are many times the size that is estimated for them, so neither side may be sent to the driver by that estimate.
    hits = runs(stem_words, "question_id", "course_id").join(known.hint("merge"), ["course_id", "gram"])
    return hits.groupBy("question_id").agg(F.min("gram").alias("first_gram"), F.count("*").alias("grams"))


def packed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The workbooks' pages packed into chunks."""
    return pack_pages(_pages(spark, sf_dir))


def chapter_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Range join: pages, their characters and their tokens by chapter, through the pages that a chapter spans."""
    spans = read(spark, sf_dir, "chapters").select("chapter_id", "course_id", F.explode(F.sequence("page_start", "page_end")).alias("page_number"))
    source = read(spark, sf_dir, "parse_results").select("source_id", "course_id").distinct()
    pages = _pages(spark, sf_dir).join(source, "source_id").select("course_id", "page_number", "text")
    return spans.join(pages, ["course_id", "page_number"]).groupBy("chapter_id").agg(
        F.count("*").alias("pages"), F.sum(F.coalesce(F.length("text"), F.lit(0))).cast("long").alias("chars"), F.sum(F.coalesce(X.token_count(F.col("text")), F.lit(0))).cast("long").alias("tokens")
    )


def chapter_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each chapter's end from the next one's start, and whether the stored spans overlap."""
    order = Window.partitionBy("course_id").orderBy("page_start", "ordinal")
    nxt = F.lead("page_start").over(order)
    return read(spark, sf_dir, "chapters").select(
        "chapter_id", "course_id", "page_start", F.greatest("page_start", F.coalesce(nxt - 1, "page_end")).alias("derived_end"), F.coalesce(F.lag("page_end").over(order) >= F.col("page_start"), F.lit(False)).alias("overlaps")
    )


def scanned_only_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks all of whose pages were read by character recognition; swapped page ranges are put right."""
    lo, hi = F.least("page_start", "page_end"), F.greatest("page_start", "page_end")
    spans = _chunks(spark, sf_dir, "source_id", "page_start", "page_end").filter("page_start is not null and page_end is not null").select("chunk_id", "source_id", F.explode(F.sequence(lo, hi)).alias("page_number"))
    seen = _pages(spark, sf_dir).groupBy("source_id", "page_number").agg(F.max(F.col("ocr_used").cast("int")).alias("ocr"))
    joined = spans.join(seen, ["source_id", "page_number"], "left").groupBy("chunk_id").agg(F.min(F.coalesce("ocr", F.lit(0))).alias("all_ocr"))
    return joined.filter("all_ocr = 1").select("chunk_id")


def keyword_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By chapter: keywords of all its drafts, cleaned and counted."""
    words = _drafts(spark, sf_dir, "chapter_id", "keywords").select("chapter_id", F.explode("keywords").alias("k")).select("chapter_id", F.lower(F.trim("k")).alias("keyword")).filter("keyword <> ''")
    return words.groupBy("chapter_id", "keyword").agg(F.count("*").alias("uses"))


def kept_prerequisites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Semi-join: prerequisites that name another draft of the course, their place counted anew."""
    drafts = _drafts(spark, sf_dir, "course_id", "title", "prerequisites")
    asked = drafts.select("concept_id", "course_id", title_form("title").alias("own"), F.posexplode("prerequisites").alias("pos", "p")).withColumn("form", title_form("p"))
    known = drafts.select("course_id", title_form("title").alias("form")).filter("form is not null").distinct()
    kept = asked.join(known, ["course_id", "form"], "left_semi").filter("own is null or form <> own")
    place = F.row_number().over(Window.partitionBy("concept_id").orderBy("pos"))
    return kept.select("concept_id", place.alias("place"), "form")


def orphan_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anti-joins: drafts without any question, and whether they lack a chapter too."""
    drafts = _drafts(spark, sf_dir, "chapter_id", "review_status").filter("review_status <> 'dropped'")
    return drafts.join(questions(spark, sf_dir, "concept_id").select("concept_id"), "concept_id", "left_anti").select("concept_id", F.col("chapter_id").isNull().alias("no_chapter"))


def repeated_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions whose stem another of the course already has, white space and case aside; with the one they repeat."""
    rows = questions(spark, sf_dir, "course_id", "stem").filter("stem is not null").select("question_id", "course_id", F.sha2(X.text_form(F.col("stem")), 256).alias("form"))
    first = rows.groupBy("course_id", "form").agg(F.min("question_id").alias("first_id"), F.count("*").alias("cnt")).filter("cnt > 1")
    named = first.select("form", F.col("course_id").alias("c"), "first_id", "cnt")
    return lookup(rows, named, "form").filter("c = course_id and question_id <> first_id").select("question_id", "first_id")


def option_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first structural fault of every question, if any."""
    options = questions(spark, sf_dir, "stem", "options", "correct_key")
    keys = F.transform("options", lambda o: o["key"])
    texts = F.transform("options", lambda o: X.text_form(o["text"]))
    reason = (
        F.when(F.coalesce(F.size("options"), F.lit(0)) != 4, "option count")
        .when(F.array_sort(keys) != F.array(*map(F.lit, "ABCD")), "keys")
        .when(~F.coalesce(F.array_contains(keys, F.col("correct_key")), F.lit(False)), "no key")
        .when(F.coalesce(F.trim("stem"), F.lit("")) == "", "no stem")
        .when(F.size(F.array_distinct(texts)) < 4, "equal options")
        .when(F.exists(texts, lambda t: t.contains("all of the above") | t.contains("none of the above")), "banned phrase")
    )
    return options.select("question_id", reason.alias("fault"))


def gate_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions by first fault."""
    return option_gate(spark, sf_dir).groupBy(F.coalesce("fault", F.lit("none")).alias("fault")).agg(F.count("*").alias("n"))


def late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By week of receipt: attempts, how many came over a day late, nulls of confidence first."""
    rows = read(spark, sf_dir, "attempt_outcomes").select("attempt_id", "confidence", "created_at", "received_at").groupBy("attempt_id", "confidence", "created_at").agg(F.min("received_at").alias("received_at"))
    late = F.unix_micros("received_at") - F.unix_micros("created_at") > 86_400_000_000
    week = F.floor(F.unix_micros("received_at") / 604_800_000_000)
    return rows.groupBy(week.cast("long").alias("week"), "confidence").agg(F.count("*").alias("n"), F.count_if(late).alias("late")).orderBy(F.asc_nulls_first("confidence"), "week")


QUERIES = {
    f.__name__: f
    for f in (
        token_counts, chunk_gate, dehyphenated, page_chrome, parse_coverage, line_kinds, sentence_counts, content_duplicates, bank_contamination, packed_chunks, chapter_pages,
        chapter_spans, scanned_only_chunks, keyword_union, kept_prerequisites, orphan_drafts, repeated_stems, option_gate, gate_tally, late_rows,
    )
}

_T = r"""WITH ch AS (SELECT DISTINCT ON (chunk_id) * FROM chunks), pg AS (SELECT DISTINCT ON (page_id) * FROM parsed_pages), qs AS (SELECT DISTINCT ON (question_id) * FROM questions),
dr AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY concept_id ORDER BY updated_at DESC) AS rn FROM concept_drafts) WHERE rn = 1)
"""
_TOK = r"len(regexp_extract_all({}, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s]'))"
_FORM = r"trim(regexp_replace(lower({}), '\s+', ' ', 'g'))"
_GATE = _T + r""", f AS (SELECT question_id, stem, correct_key, options, list_transform(options, lambda o: o.key) AS k, list_transform(options, lambda o: lower(regexp_replace(trim(o.text), '\s+', ' ', 'g'))) AS t FROM qs),
g AS (SELECT question_id, CASE WHEN coalesce(len(options), 0) <> 4 THEN 'option count' WHEN list_sort(k) <> ['A', 'B', 'C', 'D'] THEN 'keys' WHEN NOT coalesce(list_contains(k, correct_key), false) THEN 'no key'
  WHEN coalesce(trim(stem), '') = '' THEN 'no stem' WHEN len(list_distinct(t)) < 4 THEN 'equal options'
  WHEN len(list_filter(t, lambda x: contains(x, 'all of the above') OR contains(x, 'none of the above'))) > 0 THEN 'banned phrase' END AS fault FROM f)
"""

SQL = {
    "token_counts": _T + f"SELECT chunk_id, {_TOK.format('content')}::BIGINT AS tokens, token_count AS stored FROM ch",
    "chunk_gate": _T + f""", s AS (SELECT course_id, {_TOK.format('content')} AS t FROM ch)
SELECT course_id, count(*) AS n, count(*) FILTER (WHERE t < 300) AS small, count(*) FILTER (WHERE t > 1400) AS large, sum(t)::BIGINT AS tokens, quantile_cont(t, 0.5) AS median FROM s GROUP BY course_id""",
    "dehyphenated": _T + r""", f AS (SELECT page_id, text, regexp_replace(text, '([A-Za-z])-\n([a-z])', '\1\2', 'g') AS t FROM pg WHERE text IS NOT NULL)
SELECT page_id, md5(t) AS digest, ((length(text) - length(t)) // 2)::BIGINT AS joined FROM f""",
    "page_chrome": _T + r""", l AS (SELECT source_id, page_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS ls FROM pg WHERE text IS NOT NULL), p AS (SELECT * FROM l WHERE len(ls) > 0),
e AS (SELECT source_id, page_id, 'top' AS side, ls[1] AS line FROM p UNION ALL SELECT source_id, page_id, 'bottom', ls[-1] FROM p),
c AS (SELECT source_id, side, regexp_replace(regexp_replace(lower(trim(line)), '[0-9]', '#', 'g'), '\s+', ' ', 'g') AS form, count(DISTINCT page_id) AS pages FROM e GROUP BY 1, 2, 3),
t AS (SELECT source_id, count(*) AS n FROM p GROUP BY source_id)
SELECT source_id, side, form, pages FROM c JOIN t USING (source_id) WHERE pages >= greatest(2, floor(n * 0.30::DOUBLE))""",
    "parse_coverage": _T + """SELECT source_id, count(*) AS pages, count(*) FILTER (WHERE length(trim(coalesce(text, ''))) >= 40) AS filled, count(*) FILTER (WHERE ocr_used) AS scanned,
  round(avg((length(trim(coalesce(text, ''))) >= 40)::INT), 6) AS coverage FROM pg GROUP BY source_id""",
    "line_kinds": _T + r""", l AS (SELECT chunk_id, unnest(string_split(content, chr(10))) AS line FROM ch)
SELECT chunk_id, CASE WHEN contains(line, ' | ') THEN 'table' WHEN regexp_matches(line, '(?i)^\s*(example|illustration|case)\b') THEN 'example' ELSE 'prose' END AS kind, count(*) AS n FROM l WHERE trim(line) <> '' GROUP BY 1, 2""",
    "sentence_counts": r"""WITH s AS (SELECT doc_id, list_filter(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '') AS s FROM documents WHERE text IS NOT NULL)
SELECT doc_id, len(s)::BIGINT AS sentences, coalesce(list_max(list_transform(s, lambda x: length(x))), 0)::BIGINT AS longest FROM s""",
    "content_duplicates": "SELECT sha256(text) AS digest, count(*) AS copies, min(doc_id) AS first_id FROM documents WHERE text <> '' GROUP BY 1 HAVING count(*) > 1",
    "bank_contamination": _T + r""", cw AS (SELECT course_id, regexp_extract_all(lower(content), '[a-z0-9]+') AS w FROM ch), qw AS (SELECT question_id, course_id, regexp_extract_all(lower(stem), '[a-z0-9]+') AS w FROM qs),
cg AS (SELECT DISTINCT course_id, array_to_string(w[i:i + 7], ' ') AS gram FROM (SELECT course_id, w, unnest(generate_series(1, len(w) - 7)) AS i FROM cw WHERE len(w) >= 8)),
qg AS (SELECT DISTINCT question_id, course_id, array_to_string(w[i:i + 7], ' ') AS gram FROM (SELECT question_id, course_id, w, unnest(generate_series(1, len(w) - 7)) AS i FROM qw WHERE len(w) >= 8))
SELECT question_id, min(gram) AS first_gram, count(*) AS grams FROM qg JOIN cg USING (course_id, gram) GROUP BY question_id""",
    "chapter_pages": _T + f""", src AS (SELECT DISTINCT source_id, course_id FROM parse_results), p AS (SELECT course_id, page_number, text FROM pg JOIN src USING (source_id))
SELECT chapter_id, count(*) AS pages, sum(coalesce(length(text), 0))::BIGINT AS chars, sum(coalesce({_TOK.format('text')}, 0))::BIGINT AS tokens
FROM chapters c JOIN p ON p.course_id = c.course_id AND p.page_number BETWEEN c.page_start AND c.page_end GROUP BY chapter_id""",
    "chapter_spans": """SELECT chapter_id, course_id, page_start, greatest(page_start, coalesce(lead(page_start) OVER w - 1, page_end)) AS derived_end, coalesce(lag(page_end) OVER w >= page_start, false) AS overlaps
FROM chapters WINDOW w AS (PARTITION BY course_id ORDER BY page_start, ordinal)""",
    "scanned_only_chunks": _T + """, sp AS (SELECT chunk_id, source_id, unnest(generate_series(least(page_start, page_end), greatest(page_start, page_end))) AS page_number FROM ch WHERE page_start IS NOT NULL AND page_end IS NOT NULL),
o AS (SELECT source_id, page_number, max(ocr_used::INT) AS ocr FROM pg GROUP BY 1, 2)
SELECT chunk_id FROM sp LEFT JOIN o USING (source_id, page_number) GROUP BY chunk_id HAVING min(coalesce(ocr, 0)) = 1""",
    "keyword_union": _T + "SELECT chapter_id, lower(trim(k)) AS keyword, count(*) AS uses FROM (SELECT chapter_id, unnest(keywords) AS k FROM dr) WHERE lower(trim(k)) <> '' GROUP BY 1, 2",
    "kept_prerequisites": _T + f""", a AS (SELECT concept_id, course_id, {_FORM.format('title')} AS own, p.pos, {_FORM.format('prerequisites[p.pos]')} AS form FROM dr, LATERAL (SELECT unnest(generate_series(1, len(prerequisites))) AS pos) p),
k AS (SELECT DISTINCT course_id, {_FORM.format('title')} AS form FROM dr WHERE title IS NOT NULL)
SELECT concept_id, row_number() OVER (PARTITION BY concept_id ORDER BY pos)::INT AS place, form FROM a SEMI JOIN k USING (course_id, form) WHERE own IS NULL OR form <> own""",
    "orphan_drafts": _T + "SELECT concept_id, chapter_id IS NULL AS no_chapter FROM dr WHERE review_status <> 'dropped' AND concept_id NOT IN (SELECT concept_id FROM qs WHERE concept_id IS NOT NULL)",
    "repeated_stems": _T + r""", f AS (SELECT question_id, course_id, lower(regexp_replace(trim(stem), '\s+', ' ', 'g')) AS form FROM qs WHERE stem IS NOT NULL),
m AS (SELECT question_id, min(question_id) OVER (PARTITION BY course_id, form) AS first_id FROM f) SELECT question_id, first_id FROM m WHERE question_id <> first_id""",
    "option_gate": _GATE + "SELECT question_id, fault FROM g",
    "gate_tally": _GATE + "SELECT coalesce(fault, 'none') AS fault, count(*) AS n FROM g GROUP BY 1",
    "late_rows": """WITH a AS (SELECT attempt_id, confidence, created_at, min(received_at) AS received_at FROM attempt_outcomes GROUP BY 1, 2, 3)
SELECT epoch_us(received_at) // 604800000000 AS week, confidence, count(*) AS n, count(*) FILTER (WHERE epoch_us(received_at) - epoch_us(created_at) > 86400000000) AS late FROM a GROUP BY 1, 2""",
}
