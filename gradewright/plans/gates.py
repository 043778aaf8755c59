"""Gates, audits and predictions over whole courses: acceptance in turn, gate chains, time windows, score bands."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradewright import config as C
from gradewright.functions import learning as L
from gradewright.functions.json import faults_of, setting
from gradewright.functions.text import token_count
from gradewright.operators import fold
from gradewright.operators.draws import paper_scores
from gradewright.operators.hierarchy import latest_rows
from gradewright.operators.vectors import accepted_in_turn
from gradewright.plans import composition, learning, text, vectors
from gradewright.plans.composition import mock_paper
from gradewright.plans.learning import _factors, _latest, attempts, questions
from gradewright.scratch import Scratch
from gradewright.tables import read


def _stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = questions(spark, sf_dir, "course_id", "stem")
    return vectors._text_vectors(q.select(F.col("question_id").alias("id"), F.col("stem").alias("text"), "course_id"), "course_id")


def accepted_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stems of a course taken in turn: each is accepted unless a duplicate of one accepted before."""
    return accepted_in_turn(_stems(spark, sf_dir), C.DUPLICATE_COS, "course_id").withColumnRenamed("id", "question_id")


def gate_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first gate that turns a question away: its structure, a run of words lifted from a chunk, a duplicate of one that passed all before; null if none.

    A later gate sees only what passed the ones before it.
    """
    first = text.option_gate(spark, sf_dir).select("question_id", F.when(F.col("fault").isNotNull(), "structure").alias("g1"))
    lifted = text.bank_contamination(spark, sf_dir).select("question_id", F.lit("lift").alias("g4"))
    early = Scratch(spark, "gates").write(first.join(lifted, "question_id", "left").select("question_id", F.coalesce("g1", "g4").alias("gate")))
    left = early.filter("gate is null").select(F.col("question_id").alias("id"))
    turn = accepted_in_turn(_stems(spark, sf_dir).join(left, "id", "left_semi"), C.DUPLICATE_COS, "course_id").filter("not accepted").select(F.col("id").alias("question_id"), F.lit("duplicate").alias("g5"))
    return early.join(turn, "question_id", "left").select("question_id", F.coalesce("gate", "g5").alias("gate"))


def _now(spark: SparkSession, sf_dir: str):
    return read(spark, sf_dir, "attempt_outcomes").agg(F.max("created_at")).scalar()


def eligible_counts(spark: SparkSession, sf_dir: str, days: int = C.RESERVE_DAYS) -> DataFrame:
    """By learner and concept met: its questions, and those the learner has not tried within the reserve days before the log's end."""
    met = _latest(spark, sf_dir).filter("user_id is not null").select("user_id", "concept_id")
    bank = questions(spark, sf_dir, "concept_id").filter("concept_id is not null")
    fresh = attempts(spark, sf_dir, "user_id", "question_id", "created_at").filter((F.col("created_at") > _now(spark, sf_dir) - F.expr(f"INTERVAL {days} DAYS")) & F.col("user_id").isNotNull())
    tried = fresh.join(bank, "question_id").groupBy("user_id", "concept_id").agg(F.count_distinct("question_id").alias("tried"))
    sizes = bank.groupBy("concept_id").agg(F.count("*").alias("questions"))
    return met.join(sizes, "concept_id").join(tried, ["user_id", "concept_id"], "left").select("user_id", "concept_id", "questions", (F.col("questions") - F.coalesce("tried", F.lit(0))).alias("eligible"))


def due_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By learner: concepts whose memory is due by the log's end, and those with an open misconception."""
    stable = fold.stability_fold(_factors(spark, sf_dir)).filter("user_id is not null").select("user_id", "concept_id", "stability")
    flags = learning.misconception_flags(spark, sf_dir).filter("user_id is not null")
    seen = _latest(spark, sf_dir).select("user_id", "concept_id", "last_seen")
    due = L.days_between(_now(spark, sf_dir), F.col("last_seen")) >= F.round(L.days_until_due(F.col("stability")), 6)
    rows = seen.join(stable, ["user_id", "concept_id"]).join(flags, ["user_id", "concept_id"])
    return rows.groupBy("user_id").agg(F.count_if(due).alias("due"), F.count_if(F.col("flag") > 0).alias("flagged"), F.count("*").alias("concepts"))


def open_caselets(spark: SparkSession, sf_dir: str, days: int = C.REUSE_DAYS) -> DataFrame:
    """Caselets with a concept the learner has met and not tried within the reuse days, by how weak the learner is on their concepts, each concept once.

    Concepts never met count with the mastery of ability 0. Caselets of none but such are the same for all and left out.
    """
    members = questions(spark, sf_dir, "case_group_id", "concept_id").filter("case_group_id is not null")
    concepts = members.filter("concept_id is not null").select("case_group_id", "concept_id").distinct()
    sizes = concepts.groupBy("case_group_id").agg(F.count("*").alias("concepts"))
    blank = L.mastery(F.lit(0.0))
    state = _latest(spark, sf_dir).filter("user_id is not null").select("user_id", "concept_id", L.mastery(F.col("theta")).alias("m"))
    known = state.join(concepts, "concept_id").groupBy("user_id", "case_group_id").agg(F.sum(blank - F.col("m")).alias("more"))
    recent = attempts(spark, sf_dir, "user_id", "question_id", "created_at").filter(F.col("created_at") >= _now(spark, sf_dir) - F.expr(f"INTERVAL {days} DAYS")).join(members.select("question_id", "case_group_id"), "question_id")
    left = known.join(recent.select("user_id", "case_group_id").distinct(), ["user_id", "case_group_id"], "left_anti").join(sizes, "case_group_id")
    weak = F.round(F.col("concepts") * (1 - blank) + F.col("more"), 6)
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("weakness"), F.desc(F.col("case_group_id").cast("string"))))
    return left.withColumn("weakness", weak).select("user_id", "case_group_id", "concepts", "weakness", place.cast("long").alias("place"))


def predicted_scores(spark: SparkSession, sf_dir: str, draws: int = 1000) -> DataFrame:
    """What every learner of a course may expect of its paper, by section and (section null) in all: expected marks, band, chance to pass, and whether too little was practised to say.

    Sections are single questions and caselets of one and of two marks. 1,000 draws of ability and answers; the pass mark is 0.6 of the marks.
    """
    bank = questions(spark, sf_dir, "concept_id", "q_rating", "marks", "case_group_id").filter("q_rating is not null and marks is not null")
    tier = F.max("marks").over(Window.partitionBy("case_group_id"))
    section = F.when(F.col("case_group_id").isNull(), "single").when(tier >= 2, "caselet 2").otherwise("caselet 1")
    paper = mock_paper(spark, sf_dir).select("course_id", "question_id").join(bank.withColumn("section", section).drop("case_group_id"), "question_id")
    state = _latest(spark, sf_dir).filter("user_id is not null").select("user_id", "concept_id", "theta", "n")
    courses = latest_rows(read(spark, sf_dir, "concept_drafts").select("concept_id", "course_id", "updated_at"), "concept_id", "updated_at").select("concept_id", "course_id")
    courses = courses.filter("course_id is not null").withColumn("own", F.lit(True))
    asked = courses.unionByName(paper.select("concept_id", "course_id", F.lit(False).alias("own"))).groupBy("concept_id", "course_id").agg(F.max("own").alias("own"))
    met = state.join(asked, "concept_id")
    learners = met.filter("own").select("user_id", "course_id").distinct()
    states = met.join(learners, ["user_id", "course_id"], "left_semi").select("user_id", "course_id", "concept_id", "theta", "n")
    r = lambda c, digits=4: F.round(c, digits).alias(c)
    return paper_scores(paper.withColumnRenamed("q_rating", "q"), states, draws).select(
        "user_id", "course_id", "section", r("expected"), r("out_of"), r("low", 6), r("high", 6), r("p_pass"), r("coverage"), (F.col("coverage") < C.MIN_COVERAGE).alias("suppressed")
    )


def card_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions as cards that a learner grades 1 (wrong), 2 (right, not sure) or 3 (right and sure): stability after all grades, and the days until the card is due again."""
    rows = attempts(spark, sf_dir, "user_id", "question_id", "correct", "confidence", "created_at").filter("correct is not null")
    grade = F.when(~F.col("correct"), 1).when(F.col("confidence") == "sure", 3).otherwise(2)
    factor = L.card_factor(F.col("grade"))
    done = fold.stability_fold(rows.withColumn("grade", grade).select("user_id", F.col("question_id").alias("concept_id"), "attempt_id", "created_at", factor.alias("factor")))
    return done.select("user_id", F.col("concept_id").alias("question_id"), F.round("stability", 6).alias("stability"), F.round(L.days_until_due(F.col("stability")), 5).alias("days"), "n")


def ingest_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All failures of a course's intake in one list: pages without text, chunks out of bounds, chunks that cover too little of the pages, drafts without a reviewed state."""
    sources = read(spark, sf_dir, "parse_results").select("source_id", "course_id").distinct()
    pages = latest_rows(read(spark, sf_dir, "parsed_pages").select("page_id", "source_id", "text"), "page_id", "text").join(sources, "source_id")
    chunks = latest_rows(read(spark, sf_dir, "chunks").select("chunk_id", "course_id", "content", "created_at"), "chunk_id", "created_at")
    page = pages.groupBy("course_id").agg(F.count("*").alias("n"), F.count_if(F.length(F.trim(F.coalesce("text", F.lit("")))) >= C.MIN_PAGE_CHARS).alias("good"), F.sum(F.coalesce(token_count(F.col("text")), F.lit(0))).alias("tokens"))
    tokens = F.coalesce(token_count(F.col("content")), F.lit(0))
    chunk = chunks.filter("course_id is not null").groupBy("course_id").agg(F.count_if(~tokens.between(C.CHUNK_MIN, C.CHUNK_MAX)).alias("off"), F.sum(tokens).alias("chunk_tokens"))
    drafts = latest_rows(read(spark, sf_dir, "concept_drafts").select("concept_id", "course_id", "review_status", "updated_at"), "concept_id", "updated_at")
    draft = drafts.filter("course_id is not null").groupBy("course_id").agg(F.count_if(F.coalesce("review_status", F.lit("draft")) == "draft").alias("open"))
    cover = F.round(F.least(F.lit(1.0), F.coalesce("chunk_tokens", F.lit(0)) / F.col("tokens")), 6)
    fault = lambda df, gate, value, bad: df.filter(bad).select("course_id", F.lit(gate).alias("gate"), value.cast("double").alias("value"))
    return reduce(DataFrame.unionByName, [
        fault(page, "parse", F.round(F.col("good") / F.col("n"), 6), F.col("good") < C.PARSE_LEAST * F.col("n")), fault(chunk, "chunk size", F.col("off"), F.col("off") > 0),
        fault(page.filter("tokens > 0").join(chunk, "course_id", "left"), "chunk coverage", cover, cover < C.COVER_LEAST), fault(draft, "review", F.col("open"), F.col("open") > 0),
    ])


def unknown_prerequisites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By course: prerequisites that are the title of no draft of it."""
    from gradewright.operators.hierarchy import title_form

    d = latest_rows(read(spark, sf_dir, "concept_drafts").select("concept_id", "course_id", "title", "prerequisites", "updated_at"), "concept_id", "updated_at").filter("course_id is not null")
    asked = d.select("course_id", F.explode("prerequisites").alias("p")).select("course_id", title_form("p").alias("form")).filter("form <> ''")
    return asked.subtract(d.select("course_id", title_form("title").alias("form")))


def chosen_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every wrong answer with a noted choice: the text and the misconception of the option chosen."""
    rows = attempts(spark, sf_dir, "question_id", "chosen_key", "correct").filter("chosen_key is not null and not correct").join(questions(spark, sf_dir, "options"), "question_id")
    option = F.get(F.filter("options", lambda o: o["key"] == F.col("chosen_key")), F.lit(0))
    return rows.withColumn("o", option).groupBy("question_id", "chosen_key").agg(F.min("o.text").alias("text"), F.min("o.misconception").alias("misconception"), F.count("*").alias("n"))


def caselet_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The questions of every caselet dealt out to its concepts in turn, concepts by id."""
    q = questions(spark, sf_dir, "case_group_id", "case_position", "concept_id").filter("case_group_id is not null")
    ids = q.filter("concept_id is not null").groupBy("case_group_id").agg(F.array_sort(F.collect_set("concept_id")).alias("ids"))  # a caselet's few
    place = F.row_number().over(Window.partitionBy("case_group_id").orderBy(F.coalesce("case_position", F.lit(0)), "question_id"))
    return q.withColumn("i", place).join(ids, "case_group_id").select("case_group_id", "question_id", F.element_at("ids", F.pmod(F.col("i") - 1, F.size("ids")).cast("int") + 1).alias("concept_id"))


def event_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By event type: how many events' properties hold to their schema, and the sums of a setting read by the first path that has it, with a default."""
    e = read(spark, sf_dir, "events").select("event_type", "props")
    ok = F.size(faults_of({"type": "object", "required": ["k"], "properties": {"k": {"type": "integer"}}})("props")) == 0
    return e.select("event_type", ok.alias("ok"), setting(F.col("props"), "$.exam.k", "$.k", default=0).alias("k"), setting(F.col("props"), "$.exam.total", default=150).alias("total")).groupBy("event_type").agg(
        F.count("*").alias("n"), F.count_if("ok").alias("valid"), F.sum("k").alias("k"), F.sum("total").alias("total")
    )


QUERIES = {
    f.__name__: f
    for f in (
        accepted_stems, gate_verdicts, eligible_counts, due_counts, open_caselets, predicted_scores, card_reviews, ingest_failures, unknown_prerequisites, chosen_options, caselet_turns, event_settings,
    )
}

_TURN = """, nb AS (SELECT b AS id, list(a) AS near FROM cs WHERE cos >= 0.90 AND a < b GROUP BY b), e AS (
  SELECT {{'id': i.id, 'near': coalesce(nb.near, []::BIGINT[]), 'taken': []::BIGINT[]}} AS e FROM ({ids}) i LEFT JOIN nb ON nb.id = i.id
), done AS (
  SELECT list_reduce(list_prepend({{'id': -1::BIGINT, 'near': []::BIGINT[], 'taken': []::BIGINT[]}}, list(e ORDER BY e.id)),
    lambda s, x: {{'id': x.id, 'near': x.near, 'taken': CASE WHEN list_has_any(s.taken, x.near) THEN s.taken ELSE list_append(s.taken, x.id) END}}).taken AS taken FROM e
)
"""
_PAIRS = "p AS (SELECT 'q' AS ka, x.id AS a, 'q' AS kb, y.id AS b FROM texts x JOIN texts y ON x.kind = 'q' AND y.kind = 'q' AND x.course_id = y.course_id AND x.id <> y.id WHERE {}), " + vectors._COS
_STEM_IDS = "SELECT id FROM texts WHERE kind = 'q' AND text IS NOT NULL AND course_id IS NOT NULL"
_NOW = ", now AS (SELECT max(created_at) AS now FROM att)"

SQL = {
    "accepted_stems": vectors._WORDS + _PAIRS.format("true") + _TURN.format(ids=_STEM_IDS) + "SELECT e.id AS question_id, list_contains(taken, e.id) AS accepted FROM e, done",
    "gate_verdicts": vectors._WORDS + "early AS (SELECT g.question_id, CASE WHEN fault IS NOT NULL THEN 'structure' WHEN l.question_id IS NOT NULL THEN 'lift' END AS gate FROM (" + text.SQL["option_gate"] + ") g LEFT JOIN (" + text.SQL["bank_contamination"]
    + ") l ON l.question_id = g.question_id), ok AS (SELECT question_id FROM early WHERE gate IS NULL), " + _PAIRS.format("x.id IN (FROM ok) AND y.id IN (FROM ok)") + _TURN.format(ids=_STEM_IDS + " AND id IN (FROM ok)")
    + "SELECT question_id, coalesce(gate, CASE WHEN e.e.id IS NOT NULL AND NOT list_contains(taken, question_id) THEN 'duplicate' END) AS gate FROM early LEFT JOIN e ON e.e.id = early.question_id, done",
    "eligible_counts": learning._A + _NOW + f""", t AS (SELECT a.user_id, q.concept_id, count(DISTINCT a.question_id) AS tried FROM att a JOIN (SELECT DISTINCT ON (question_id) question_id, concept_id FROM questions) q USING (question_id), now
  WHERE created_at > now - INTERVAL {C.RESERVE_DAYS} DAY GROUP BY 1, 2), s AS (SELECT concept_id, count(DISTINCT question_id) AS questions FROM questions WHERE concept_id IS NOT NULL GROUP BY 1)
SELECT m.user_id, m.concept_id, questions, questions - coalesce(tried, 0) AS eligible FROM (SELECT DISTINCT user_id, concept_id FROM att WHERE user_id IS NOT NULL) m JOIN s USING (concept_id) LEFT JOIN t USING (user_id, concept_id)""",
    "due_counts": learning._A + learning._EV + _NOW + f""", st AS (SELECT user_id, concept_id, max(created_at) AS seen, {learning._STABILITY} AS stability, {learning._FLAG} AS flag FROM f WHERE user_id IS NOT NULL GROUP BY 1, 2)
SELECT user_id, count(*) FILTER (WHERE (epoch_us(now) - epoch_us(seen)) / 8.64e10::DOUBLE >= round(-stability * ln(0.85::DOUBLE), 6)) AS due, count(*) FILTER (WHERE flag > 0) AS flagged, count(*) AS concepts FROM st, now GROUP BY 1""",
    "open_caselets": learning._A + _NOW + f""", qq AS (SELECT DISTINCT ON (question_id) question_id, case_group_id, concept_id FROM questions), c AS (SELECT DISTINCT case_group_id, concept_id FROM qq WHERE case_group_id IS NOT NULL AND concept_id IS NOT NULL),
la AS (SELECT user_id, concept_id, 1 / (1 + exp(-(arg_max(theta_after, (created_at, attempt_id)) - 0.3::DOUBLE))) AS m FROM att WHERE user_id IS NOT NULL GROUP BY 1, 2),
u AS (SELECT DISTINCT user_id, case_group_id FROM la JOIN c USING (concept_id)),
r AS (SELECT DISTINCT user_id, case_group_id FROM att JOIN qq USING (question_id), now WHERE created_at >= now - INTERVAL {C.REUSE_DAYS} DAY AND case_group_id IS NOT NULL),
w AS (SELECT u.user_id, u.case_group_id, count(*) AS concepts, round(sum(1 - coalesce(m, 1 / (1 + exp(0.3::DOUBLE)))), 6) AS weakness FROM u JOIN c USING (case_group_id) LEFT JOIN la ON la.user_id = u.user_id AND la.concept_id = c.concept_id
  WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.user_id = u.user_id AND r.case_group_id = u.case_group_id) GROUP BY 1, 2)
SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY weakness DESC, case_group_id::VARCHAR DESC) AS place FROM w""",
    "predicted_scores": learning._A + ", mp AS (" + composition.SQL["mock_paper"] + f"""), bank AS (SELECT DISTINCT ON (question_id) question_id, concept_id, q_rating, marks, case_group_id FROM questions WHERE q_rating IS NOT NULL AND marks IS NOT NULL),
sec AS (SELECT *, CASE WHEN case_group_id IS NULL THEN 'single' WHEN max(marks) OVER (PARTITION BY case_group_id) >= 2 THEN 'caselet 2' ELSE 'caselet 1' END AS section FROM bank),
paper AS (SELECT mp.course_id, sec.* FROM mp JOIN sec USING (question_id)), la AS (SELECT user_id, concept_id, arg_max(theta_after, (created_at, attempt_id)) AS theta, count(*) AS n FROM att WHERE user_id IS NOT NULL GROUP BY 1, 2),
lc AS (SELECT DISTINCT user_id, course_id FROM la JOIN drafts USING (concept_id)),
it AS (SELECT lc.user_id, paper.course_id, section, question_id, marks, q_rating AS q, coalesce(theta, 0.0::DOUBLE) AS theta, 1.2::DOUBLE / sqrt(1.0::DOUBLE + coalesce(n, 0)) AS se, coalesce(n, 0) > 0 AS met
  FROM lc JOIN paper USING (course_id) LEFT JOIN la ON la.user_id = lc.user_id AND la.concept_id = paper.concept_id),
ex AS (SELECT user_id, course_id, coalesce(section, 'all') AS section, sum(CASE WHEN p >= 0.2::DOUBLE THEN p * marks - (1 - p) * 0.25::DOUBLE * marks ELSE 0.0 END) AS expected, sum(marks) AS out_of, avg(met::INT) AS coverage
  FROM (SELECT *, 1 / (1 + exp(-(theta - q))) AS p FROM it) GROUP BY GROUPING SETS ((user_id, course_id), (user_id, course_id, section))),
sd AS (SELECT *, {learning._seed("'r|' || user_id || '|' || question_id")} AS s1, {learning._seed("'a|' || user_id || '|' || question_id")} AS s2, {learning._seed("'x|' || user_id || '|' || question_id")} AS s3 FROM it),
d AS (SELECT user_id, course_id, section, marks, b, {learning._uniform("s3", "b")} AS u3, 1 / (1 + exp(-(theta + se * sqrt(-2 * ln({learning._uniform("s1", "b")})) * cos(6.283185307179586::DOUBLE * {learning._uniform("s2", "b")}) - q))) AS p
  FROM sd, (SELECT unnest(generate_series(1, 1000)) AS b)),
t AS (SELECT user_id, course_id, coalesce(section, 'all') AS section, b, sum(CASE WHEN p < 0.2::DOUBLE THEN 0.0 WHEN u3 < p THEN marks ELSE -0.25 * marks END)::DOUBLE AS score, sum(marks) AS of_ FROM d GROUP BY GROUPING SETS ((user_id, course_id, b), (user_id, course_id, section, b))),
bd AS (SELECT user_id, course_id, section, quantile_cont(score, 0.025) AS low, quantile_cont(score, 0.975) AS high, avg((score >= 0.6::DOUBLE * of_)::INT) AS p_pass FROM t GROUP BY 1, 2, 3)
SELECT user_id, course_id, section, round(expected, 4) AS expected, round(out_of, 4) AS out_of, round(low, 6) AS low, round(high, 6) AS high, round(p_pass, 4) AS p_pass, round(coverage, 4) AS coverage, coverage < 0.3::DOUBLE AS suppressed FROM ex JOIN bd USING (user_id, course_id, section)""",
    "card_reviews": learning._A + """, f AS (SELECT *, CASE WHEN NOT correct THEN 0.35::DOUBLE / 1.6::DOUBLE WHEN confidence = 'sure' THEN 1 + (1.4::DOUBLE + 0.4::DOUBLE - 1) ELSE 1 + (1.4::DOUBLE + 0.4::DOUBLE - 1) * 0.7::DOUBLE END AS factor FROM att WHERE correct IS NOT NULL)
, st AS (SELECT user_id, question_id, """ + learning._STABILITY + """ AS s, count(*) AS n FROM f GROUP BY 1, 2) SELECT user_id, question_id, round(s, 6) AS stability, round(-s * ln(0.85::DOUBLE), 5) AS days, n FROM st""",
    "ingest_failures": r"""WITH pg AS (SELECT page_id, any_value(course_id) AS course_id, max(text) AS text FROM parsed_pages JOIN (SELECT DISTINCT source_id, course_id FROM parse_results) USING (source_id) GROUP BY 1),
ch AS (SELECT DISTINCT ON (chunk_id) chunk_id, course_id, coalesce(len(regexp_extract_all(content, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]')), 0) AS t FROM chunks), dr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY concept_id ORDER BY updated_at DESC) AS rn FROM concept_drafts) WHERE rn = 1),
page AS (SELECT course_id, count(*) AS n, count(*) FILTER (WHERE length(trim(coalesce(text, ''))) >= 40) AS good, sum(coalesce(len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]')), 0)) AS tokens FROM pg GROUP BY 1),
chunk AS (SELECT course_id, count(*) FILTER (WHERE t NOT BETWEEN 300 AND 1400) AS off, sum(t) AS tokens FROM ch WHERE course_id IS NOT NULL GROUP BY 1),
cover AS (SELECT p.course_id, round(least(1.0::DOUBLE, coalesce(c.tokens, 0)::DOUBLE / p.tokens), 6) AS v FROM page p LEFT JOIN chunk c USING (course_id) WHERE p.tokens > 0)
SELECT course_id, 'parse' AS gate, round(good::DOUBLE / n, 6) AS value FROM page WHERE good < 0.98 * n UNION ALL SELECT course_id, 'chunk size', off::DOUBLE FROM chunk WHERE off > 0 UNION ALL SELECT course_id, 'chunk coverage', v FROM cover WHERE v < 0.97
UNION ALL SELECT course_id, 'review', count(*)::DOUBLE FROM dr WHERE coalesce(review_status, 'draft') = 'draft' AND course_id IS NOT NULL GROUP BY 1""",
    "unknown_prerequisites": r"""WITH dr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY concept_id ORDER BY updated_at DESC) AS rn FROM concept_drafts) WHERE rn = 1 AND course_id IS NOT NULL),
p AS (SELECT course_id, trim(regexp_replace(lower(p), '\s+', ' ', 'g')) AS form FROM (SELECT course_id, unnest(prerequisites) AS p FROM dr))
SELECT course_id, form FROM p WHERE form <> '' EXCEPT SELECT course_id, trim(regexp_replace(lower(title), '\s+', ' ', 'g')) FROM dr""",
    "chosen_options": learning._A + """, o AS (SELECT question_id, unnest(options) AS o FROM qs)
SELECT question_id, chosen_key, min(o.o.text) AS text, min(o.o.misconception) AS misconception, count(*) AS n FROM att LEFT JOIN o ON o.question_id = att.question_id AND o.o.key = chosen_key
WHERE chosen_key IS NOT NULL AND NOT correct GROUP BY question_id, chosen_key""".replace("SELECT question_id, chosen", "SELECT att.question_id AS question_id, chosen").replace("GROUP BY question_id", "GROUP BY att.question_id"),
    "caselet_turns": """WITH q AS (SELECT DISTINCT ON (question_id) question_id, case_group_id, case_position, concept_id FROM questions WHERE case_group_id IS NOT NULL),
i AS (SELECT case_group_id, list(DISTINCT concept_id ORDER BY concept_id) AS ids FROM q WHERE concept_id IS NOT NULL GROUP BY 1), n AS (SELECT *, row_number() OVER (PARTITION BY case_group_id ORDER BY coalesce(case_position, 0), question_id) AS i FROM q)
SELECT case_group_id, question_id, ids[(n.i - 1) % len(ids) + 1] AS concept_id FROM n JOIN i USING (case_group_id)""",
    "event_settings": """SELECT event_type, count(*) AS n, count(*) FILTER (WHERE json_type(props, '$.k') IN ('BIGINT', 'UBIGINT')) AS valid, sum(coalesce(json_extract_string(props, '$.exam.k')::DOUBLE, json_extract_string(props, '$.k')::DOUBLE, 0)) AS k,
  sum(coalesce(json_extract_string(props, '$.exam.total')::DOUBLE, 150.0::DOUBLE)) AS total FROM events GROUP BY 1""",
}
