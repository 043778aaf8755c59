"""Queries on the bank and the drafts: picks, quotas, merges, audits, time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradewright import config as C
from gradewright.functions import learning as L
from gradewright.functions.text import token_count
from gradewright.operators import fold, practice
from gradewright.operators.hierarchy import latest_rows, title_form
from gradewright.plans import learning
from gradewright.plans.learning import _factors, _latest, _priorities, attempts, questions
from gradewright.streaming.ability import accuracy_windows, study_sessions
from gradewright.tables import read


def _drafts(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return latest_rows(read(spark, sf_dir, "concept_drafts").select("concept_id", "updated_at", *columns), "concept_id", "updated_at")


def learner_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Options as a learner may see them: keys and texts, nothing that tells the answer."""
    return questions(spark, sf_dir, "options").select("question_id", F.posexplode("options").alias("i", "o")).select("question_id", F.col("o.key").alias("key"), F.col("o.text").alias("text"))


def caselet_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The questions of every caselet in order, its concepts and its tier."""
    q = questions(spark, sf_dir, "case_group_id", "case_position", "concept_id", "marks").filter("case_group_id is not null")
    ids = F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce("case_position", F.lit(0)).alias("p"), "question_id"))), lambda x: x["question_id"].cast("string"))
    return q.groupBy("case_group_id").agg(F.array_join(ids, ",").alias("question_ids"), F.count_distinct("concept_id").alias("concepts"), F.when(F.max("marks") >= 2, 2).otherwise(1).alias("tier"))


def untested_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concepts a learner never met in chapters of which the learner met some: 0.6 of the mean ability there."""
    where = _drafts(spark, sf_dir, "chapter_id").select("concept_id", "chapter_id").filter("chapter_id is not null")
    seen = _latest(spark, sf_dir).filter("user_id is not null").select("user_id", "concept_id", "theta")
    means = seen.join(where, "concept_id").groupBy("user_id", "chapter_id").agg(F.avg("theta").alias("mean"))
    open_ = means.join(where, "chapter_id").join(seen.select("user_id", "concept_id"), ["user_id", "concept_id"], "left_anti")
    return open_.select("user_id", "concept_id", F.round(F.col("mean") * 0.6, 8).alias("theta"))


def rating_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions whose rating has left that of their difficulty by over 1.5."""
    last = attempts(spark, sf_dir, "question_id", "q_rating_after", "created_at").groupBy("question_id").agg(F.max_by("q_rating_after", F.struct("created_at", "attempt_id")).alias("rating"))
    start = (F.col("difficulty") - 2) * 0.6
    return last.join(questions(spark, sf_dir, "difficulty"), "question_id").filter(F.abs(F.col("rating") - start) > 1.5).select("question_id", F.round("rating", 6).alias("rating"), F.round(start, 6).alias("start"))


def blind_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By question: votes, votes for the key, and whether all votes agree with it."""
    votes = attempts(spark, sf_dir, "question_id", "chosen_key").filter("chosen_key is not null").join(questions(spark, sf_dir, "correct_key"), "question_id")
    hit = F.col("chosen_key") == F.col("correct_key")
    return votes.groupBy("question_id").agg(F.count("*").alias("votes"), F.count_if(hit).alias("for_key"), F.bool_and(hit).alias("unanimous"))


def concept_quotas(spark: SparkSession, sf_dir: str, total: int = 2000) -> DataFrame:
    """Questions to write by course: three a concept, the rest by weakness, summing to the total exactly; mastered concepts get none.

    Where the total doesn't exceed three a concept, all of it goes by weakness, and some concepts may get none.
    """
    state = _latest(spark, sf_dir).groupBy("concept_id").agg(F.avg(L.mastery(F.col("theta"))).alias("m"))
    pool = _drafts(spark, sf_dir, "course_id").select("concept_id", "course_id").join(state, "concept_id", "left").withColumn("m", F.coalesce("m", F.lit(0.0))).filter("m < 0.9")
    n = F.count("*").over(Window.partitionBy("course_id"))
    pool = pool.withColumn("w", F.round(1 - F.col("m"), 6)).withColumn("floor", F.when(n * 3 < total, 3).otherwise(0)).withColumn("n", n)
    # What is left of the total differs by course, so shares of one unit are scaled by it.
    rest = total - F.col("floor") * F.col("n")
    own = Window.partitionBy("course_id")
    share = F.round(F.col("w") / F.sum("w").over(own) * rest, 9)
    base = pool.withColumn("q", share)
    base = base.withColumn("f", F.floor("q")).withColumn("left", rest - F.sum("f").over(own)).withColumn("p", F.row_number().over(own.orderBy(F.desc(F.round(F.col("q") - F.col("f"), 6)), "concept_id")))
    return base.select("course_id", "concept_id", (F.col("floor") + F.col("f") + F.when(F.col("p") <= F.col("left"), 1).otherwise(0)).cast("long").alias("quota"))


def blueprint_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapter weights by reviewed drafts, one at least a chapter; the first chapter is set to a tenth, the others share the rest."""
    reviewed = _drafts(spark, sf_dir, "chapter_id", "review_status").filter(F.col("review_status").isin("accepted", "edited", "merged")).groupBy("chapter_id").agg(F.count("*").alias("c"))
    base = read(spark, sf_dir, "chapters").join(reviewed, "chapter_id", "left").withColumn("b", F.greatest(F.lit(1), F.coalesce("c", F.lit(0))).cast("double"))
    own = Window.partitionBy("course_id")
    others = F.sum(F.when(F.col("ordinal") > 1, F.col("b")).otherwise(0.0)).over(own)
    return base.select("course_id", "chapter_id", F.round(F.when(F.col("ordinal") == 1, 0.1).otherwise(0.9 * F.col("b") / others), 6).alias("weight"))


def desirable_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every learner and concept the question whose rating lies nearest to the ability and a little above."""
    wants = _latest(spark, sf_dir).filter("user_id is not null").select("concept_id", F.col("user_id").alias("want_id"), F.round(F.col("theta") + C.DIFFICULTY_OFFSET, 6).alias("target"))
    offers = questions(spark, sf_dir, "concept_id", "q_rating").select("concept_id", F.col("question_id").alias("offer_id"), F.round("q_rating", 6).alias("value"))
    return practice.nearest(wants, offers.filter("concept_id is not null"), "concept_id").select("concept_id", F.col("want_id").alias("user_id"), F.col("offer_id").alias("question_id"), F.round("gap", 6).alias("gap"))


def chunk_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of each course in batches of at most 6,000 tokens."""
    rows = read(spark, sf_dir, "chunks").select("chunk_id", "course_id", "content").dropDuplicates(["chunk_id"])
    return practice.token_batches(rows.select(F.col("course_id").alias("grp"), F.col("chunk_id").alias("pos"), F.col("chunk_id").alias("id"), token_count(F.col("content")).alias("tokens")))


def concept_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of four neighbouring concepts of each chapter, closing round its end."""
    rows = _drafts(spark, sf_dir, "chapter_id").filter("chapter_id is not null").select("chapter_id", F.col("concept_id").alias("id"))
    return practice.ring_groups(rows, "chapter_id", [F.col("id")])


def difficulty_ramp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The questions of every caselet, easy ones first, chapters alternating."""
    where = _drafts(spark, sf_dir, "chapter_id").select("concept_id", "chapter_id")
    q = questions(spark, sf_dir, "case_group_id", "concept_id", "difficulty", "q_rating").filter("case_group_id is not null").join(where, "concept_id", "left")
    return practice.ramp(q.select("case_group_id", F.col("question_id").alias("id"), F.col("chapter_id").alias("chapter"), "difficulty", F.col("q_rating").alias("rating")), "case_group_id")


def merged_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drafts of one title merged: the smallest id stands for all, keywords and pages are united."""
    d = _drafts(spark, sf_dir, "course_id", "title", "keywords", "source_pages").withColumn("form", title_form("title")).filter("form is not null")
    head = d.groupBy("course_id", "form").agg(F.min("concept_id").alias("concept_id"), F.count("*").alias("drafts"))
    words = d.select("course_id", "form", F.explode("keywords").alias("k")).filter("k is not null").groupBy("course_id", "form").agg(F.count_distinct("k").alias("keywords"))
    pages = d.select("course_id", "form", F.explode("source_pages").alias("p")).filter("p is not null").groupBy("course_id", "form").agg(F.count_distinct("p").alias("pages"), F.min("p").alias("first_page"))
    out = head.join(words, ["course_id", "form"], "left").join(pages, ["course_id", "form"], "left")
    zero = F.lit(0).cast("long")
    return out.select("concept_id", "drafts", F.coalesce("keywords", zero).alias("keywords"), F.coalesce("pages", zero).alias("pages"), "first_page")


def acyclic_prerequisites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All resolved prerequisite links of the drafts, those that close cycles left out."""
    d = _drafts(spark, sf_dir, "course_id", "title", "prerequisites")
    titles = d.select("course_id", title_form("title").alias("form"), F.col("concept_id").alias("dst")).filter("form is not null").groupBy("course_id", "form").agg(F.min("dst").alias("dst"))
    asked = d.select(F.col("concept_id").alias("src"), "course_id", F.explode("prerequisites").alias("p")).select("src", "course_id", title_form("p").alias("form"))
    return practice.break_cycles(asked.join(titles, ["course_id", "form"]).select("src", "dst"))


def softmax_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The probability with which each concept would be drawn first for its learner."""
    own = Window.partitionBy("user_id")
    e = F.exp((F.col("priority") - F.max("priority").over(own)) / C.SOFTMAX_T)
    return _priorities(spark, sf_dir).withColumn("e", e).select("user_id", "concept_id", F.round(F.col("e") / F.sum("e").over(own), 6).alias("share"))


def ability_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By concept: the correlation of ability and success; 0 where one of them does not vary."""
    rows = attempts(spark, sf_dir, "concept_id", "theta_before", "correct").filter("theta_before is not null and correct is not null")
    y = F.col("correct").cast("double")
    agg = rows.groupBy("concept_id").agg(F.count("*").alias("n"), F.covar_pop("theta_before", y).alias("c"), F.stddev_pop("theta_before").alias("sx"), F.stddev_pop(y).alias("sy"))
    return agg.select("concept_id", "n", F.round(F.when((F.col("sx") > 1e-9) & (F.col("sy") > 1e-9), F.col("c") / F.col("sx") / F.col("sy")).otherwise(0.0), 6).alias("r"))


def usual_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each learner's most frequent confidence; the first in the alphabet among equals."""
    n = attempts(spark, sf_dir, "user_id", "confidence").filter("confidence is not null").groupBy("user_id", "confidence").agg(F.count("*").alias("n"))
    best = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("n"), "confidence"))
    return n.withColumn("b", best).filter("b = 1").drop("b")


def review_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each learner's memory of each concept falls to the threshold, from the replayed stability."""
    stable = fold.stability_fold(_factors(spark, sf_dir)).select("user_id", "concept_id", "stability")
    seen = _latest(spark, sf_dir).select("user_id", "concept_id", "last_seen")
    due = F.unix_micros("last_seen") / 8.64e10 + L.days_until_due(F.col("stability"))
    return stable.join(seen, ["user_id", "concept_id"]).select("user_id", "concept_id", F.round(due, 4).alias("due_day"))


def theta_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By concept: attempts whose noted ability differs from what the log itself gives, and the largest difference."""
    before = Window.partitionBy("user_id", "concept_id").orderBy("created_at", "attempt_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = attempts(spark, sf_dir, "user_id", "concept_id", "theta_before", "theta_after", "created_at")
    d = F.abs(F.col("theta_before") - F.coalesce(F.last("theta_after", True).over(before), F.lit(0.0)))
    return rows.withColumn("d", d).groupBy("concept_id").agg(F.count_if(F.col("d") > 1e-4).alias("off"), F.round(F.max("d"), 6).alias("largest"))


def accuracy_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts and right answers by day and concept."""
    rows = attempts(spark, sf_dir, "concept_id", "correct", "created_at")
    return accuracy_windows(rows).select(F.unix_micros("start").alias("start_us"), "concept_id", "n", "right")


def sittings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of attempts of each learner without a pause of half an hour."""
    rows = attempts(spark, sf_dir, "user_id", "created_at").filter("user_id is not null")
    return study_sessions(rows).select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("finish").alias("finish_us"), "n")


def events_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by type and hour: count, distinct users, and values."""
    e = read(spark, sf_dir, "events").select("event_type", "user_id", "value", F.window("ts", "1 hour").alias("w"))
    return e.groupBy("w", "event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.round(F.sum("value"), 4).alias("total")).select(
        F.date_format("w.start", "yyyy-MM-dd HH").alias("hour"), "event_type", "n", "users", "total"
    )


QUERIES = {
    f.__name__: f
    for f in (
        learner_options, caselet_items, untested_estimates, rating_review, blind_agreement, concept_quotas, blueprint_weights, desirable_pick, chunk_batches, concept_rings, difficulty_ramp,
        merged_drafts, acyclic_prerequisites, softmax_shares, ability_correlation, usual_confidence, review_due, theta_drift, accuracy_by_day, sittings, events_by_hour,
    )
}

_Q = """WITH RECURSIVE att AS (
  SELECT DISTINCT attempt_id, user_id, question_id, concept_id, correct, confidence, chosen_key, theta_before, theta_after, q_rating_before, q_rating_after, created_at FROM attempt_outcomes
), qs AS (SELECT DISTINCT ON (question_id) * FROM questions),
dr AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY concept_id ORDER BY updated_at DESC) AS rn FROM concept_drafts) WHERE rn = 1),
la AS (SELECT user_id, concept_id, arg_max(theta_after, (created_at, attempt_id)) AS theta, max(created_at) AS seen FROM att GROUP BY user_id, concept_id)
"""

SQL = {
    "learner_options": _Q + "SELECT question_id, o.key AS key, o.text AS text FROM (SELECT question_id, unnest(options) AS o FROM qs)",
    "caselet_items": _Q + """SELECT case_group_id, string_agg(question_id::VARCHAR, ',' ORDER BY coalesce(case_position, 0), question_id) AS question_ids, count(DISTINCT concept_id) AS concepts,
  CASE WHEN max(marks) >= 2 THEN 2 ELSE 1 END AS tier FROM qs WHERE case_group_id IS NOT NULL GROUP BY case_group_id""",
    "untested_estimates": _Q + """, w AS (SELECT concept_id, chapter_id FROM dr WHERE chapter_id IS NOT NULL), s AS (SELECT * FROM la WHERE user_id IS NOT NULL),
m AS (SELECT user_id, chapter_id, avg(theta) AS mean FROM s JOIN w USING (concept_id) GROUP BY 1, 2)
SELECT m.user_id, w.concept_id, round(mean * 0.6::DOUBLE, 8) AS theta FROM m JOIN w USING (chapter_id) WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.user_id = m.user_id AND s.concept_id = w.concept_id)""",
    "rating_review": _Q + """, r AS (SELECT question_id, arg_max(q_rating_after, (created_at, attempt_id)) AS rating FROM att GROUP BY 1)
SELECT question_id, round(rating, 6) AS rating, round((difficulty - 2) * 0.6::DOUBLE, 6) AS start FROM r JOIN qs USING (question_id) WHERE abs(rating - (difficulty - 2) * 0.6::DOUBLE) > 1.5""",
    "blind_agreement": _Q + """SELECT question_id, count(*) AS votes, count(*) FILTER (WHERE chosen_key = correct_key) AS for_key, bool_and(chosen_key = correct_key) AS unanimous
FROM att JOIN qs USING (question_id) WHERE chosen_key IS NOT NULL GROUP BY question_id""",
    "concept_quotas": _Q + """, st AS (SELECT concept_id, avg(1 / (1 + exp(-(theta - 0.3::DOUBLE)))) AS m FROM la GROUP BY 1),
p AS (SELECT concept_id, course_id, coalesce(m, 0.0) AS m FROM dr LEFT JOIN st USING (concept_id) WHERE coalesce(m, 0.0) < 0.9::DOUBLE),
n AS (SELECT *, round(1 - m, 6) AS w, count(*) OVER (PARTITION BY course_id) AS n FROM p),
k AS (SELECT *, CASE WHEN n * 3 < 2000 THEN 3 ELSE 0 END AS least FROM n),
q AS (SELECT *, round(w / sum(w) OVER (PARTITION BY course_id) * (2000 - least * n), 9) AS q FROM k),
f AS (SELECT *, floor(q) AS f FROM q),
r AS (SELECT *, 2000 - least * n - sum(f) OVER (PARTITION BY course_id) AS rest, row_number() OVER (PARTITION BY course_id ORDER BY round(q - f, 6) DESC, concept_id) AS place FROM f)
SELECT course_id, concept_id, (least + f + CASE WHEN place <= rest THEN 1 ELSE 0 END)::BIGINT AS quota FROM r""",
    "blueprint_weights": _Q + """, c AS (SELECT chapter_id, count(*) AS c FROM dr WHERE review_status IN ('accepted', 'edited', 'merged') GROUP BY 1),
b AS (SELECT course_id, chapter_id, ordinal, greatest(1, coalesce(c, 0))::DOUBLE AS b FROM chapters LEFT JOIN c USING (chapter_id))
SELECT course_id, chapter_id, round(CASE WHEN ordinal = 1 THEN 0.1::DOUBLE ELSE 0.9::DOUBLE * b / sum(CASE WHEN ordinal > 1 THEN b ELSE 0.0 END) OVER (PARTITION BY course_id) END, 6) AS weight FROM b""",
    "desirable_pick": _Q + """, x AS (
  SELECT la.concept_id, la.user_id, q.question_id, round(q.q_rating, 6) AS v, abs(round(q.q_rating, 6) - round(theta + 0.3::DOUBLE, 6)) AS gap FROM la JOIN qs q USING (concept_id) WHERE la.user_id IS NOT NULL AND q.q_rating IS NOT NULL
) SELECT concept_id, user_id, question_id, round(gap, 6) AS gap FROM (SELECT *, row_number() OVER (PARTITION BY concept_id, user_id ORDER BY round(gap, 9), v, question_id) AS r FROM x) WHERE r = 1""",
    "chunk_batches": r"""WITH c AS (SELECT DISTINCT ON (chunk_id) chunk_id, course_id, coalesce(len(regexp_extract_all(content, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]')), 0)::BIGINT AS n FROM chunks),
e AS (SELECT course_id, chunk_id, {'id': chunk_id, 'n': n, 'b': 0::BIGINT, 's': 0::BIGINT, 'out': []::STRUCT(id BIGINT, b BIGINT)[]} AS e FROM c),
f AS (SELECT course_id, list_reduce(list_prepend({'id': NULL::BIGINT, 'n': 0::BIGINT, 'b': 0::BIGINT, 's': 0::BIGINT, 'out': []::STRUCT(id BIGINT, b BIGINT)[]}, list(e ORDER BY chunk_id)),
  lambda a, x: CASE WHEN len(a.out) > 0 AND a.s + x.n > 6000 THEN {'id': x.id, 'n': x.n, 'b': a.b + 1, 's': x.n, 'out': list_append(a.out, {'id': x.id, 'b': a.b + 1})}
    ELSE {'id': x.id, 'n': x.n, 'b': a.b, 's': a.s + x.n, 'out': list_append(a.out, {'id': x.id, 'b': a.b})} END).out AS out FROM e GROUP BY course_id)
SELECT grp, o.id AS id, o.b AS batch FROM (SELECT course_id AS grp, unnest(out) AS o FROM f)""",
    "concept_rings": _Q + """, i AS (SELECT chapter_id, concept_id AS id, row_number() OVER (PARTITION BY chapter_id ORDER BY concept_id) - 1 AS i, count(*) OVER (PARTITION BY chapter_id) AS n FROM dr WHERE chapter_id IS NOT NULL)
SELECT chapter_id, i // 4 AS ring, i % 4 AS place, id FROM i
UNION ALL SELECT chapter_id, ceil(n / 4)::BIGINT - 1, (4 - (ceil(n / 4)::BIGINT * 4 - n) + i), id FROM i WHERE n > 4 AND i < ceil(n / 4)::BIGINT * 4 - n""",
    "merged_drafts": _Q + r""", d AS (SELECT concept_id, course_id, trim(regexp_replace(lower(title), '\s+', ' ', 'g')) AS form, keywords, source_pages FROM dr WHERE title IS NOT NULL),
h AS (SELECT course_id, form, min(concept_id) AS concept_id, count(*) AS drafts FROM d GROUP BY 1, 2),
k AS (SELECT course_id, form, count(DISTINCT k) AS keywords FROM (SELECT course_id, form, unnest(keywords) AS k FROM d) GROUP BY 1, 2),
p AS (SELECT course_id, form, count(DISTINCT p) AS pages, min(p) AS first_page FROM (SELECT course_id, form, unnest(source_pages) AS p FROM d) GROUP BY 1, 2)
SELECT concept_id, drafts, coalesce(keywords, 0) AS keywords, coalesce(pages, 0) AS pages, first_page FROM h LEFT JOIN k USING (course_id, form) LEFT JOIN p USING (course_id, form)""",
    "softmax_shares": learning._A + learning._PRIO + """, e AS (SELECT user_id, concept_id, exp((priority - max(priority) OVER (PARTITION BY user_id)) / 0.7::DOUBLE) AS e FROM prio)
SELECT user_id, concept_id, round(e / sum(e) OVER (PARTITION BY user_id), 6) AS share FROM e""",
    "ability_correlation": _Q + """, g AS (SELECT concept_id, count(*) AS n, covar_pop(theta_before, correct::INT) AS c, stddev_pop(theta_before) AS sx, stddev_pop(correct::INT) AS sy FROM att
  WHERE theta_before IS NOT NULL AND correct IS NOT NULL GROUP BY 1) SELECT concept_id, n, round(CASE WHEN sx > 1e-9 AND sy > 1e-9 THEN c / sx / sy ELSE 0.0 END, 6) AS r FROM g""",
    "usual_confidence": _Q + """, n AS (SELECT user_id, confidence, count(*) AS n FROM att WHERE confidence IS NOT NULL GROUP BY 1, 2)
SELECT user_id, confidence, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, confidence) AS r FROM n) WHERE r = 1""",
    "review_due": learning._A + learning._EV + f""", st AS (SELECT user_id, concept_id, max(created_at) AS seen, {learning._STABILITY} AS stability FROM f GROUP BY user_id, concept_id)
SELECT user_id, concept_id, round(epoch_us(seen) / 8.64e10::DOUBLE + -stability * ln(0.85::DOUBLE), 4) AS due_day FROM st""",
    "theta_drift": _Q + """, d AS (SELECT concept_id, abs(theta_before - coalesce(last_value(theta_after IGNORE NULLS) OVER (PARTITION BY user_id, concept_id ORDER BY created_at, attempt_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE)) AS d FROM att)
SELECT concept_id, count(*) FILTER (WHERE d > 1e-4) AS off, round(max(d), 6) AS largest FROM d GROUP BY 1""",
    "accuracy_by_day": _Q + "SELECT epoch_us(date_trunc('day', created_at)) AS start_us, concept_id, count(*) AS n, count(*) FILTER (WHERE correct) AS \"right\" FROM att GROUP BY 1, 2",
    "sittings": _Q + """, m AS (SELECT user_id, created_at, CASE WHEN epoch_us(created_at) - epoch_us(lag(created_at) OVER (PARTITION BY user_id ORDER BY created_at)) < 1800000000 THEN 0 ELSE 1 END AS new FROM att WHERE user_id IS NOT NULL),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY created_at RANGE UNBOUNDED PRECEDING) AS no FROM m)
SELECT user_id, epoch_us(min(created_at)) AS start_us, epoch_us(max(created_at)) + 1800000000 AS finish_us, count(*) AS n FROM s GROUP BY user_id, no""",
    "events_by_hour": """SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, event_type, count(*) AS n, count(DISTINCT user_id) AS users, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""",
}
