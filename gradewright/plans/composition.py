"""Queries that compose sessions and papers, and audits of the bank."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradewright import config as C
from gradewright.functions import learning as L
from gradewright.functions import text as X
from gradewright.operators.hierarchy import latest_rows
from gradewright.plans import learning
from gradewright.plans.learning import _latest, _priorities, attempts, chapter_seats, questions
from gradewright.tables import read


def session_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """30 concepts for every learner's next session, none twice: the 2 longest unseen, the 3 best known of the rest, then 21 drawn by priority, then 4 more.

    Each draw is one rank: who is left after the first two picks is drawn by Gumbel noise on the priority.
    """
    state = _latest(spark, sf_dir).filter("user_id is not null").join(_priorities(spark, sf_dir), ["user_id", "concept_id"])
    own = Window.partitionBy("user_id")
    unseen = F.row_number().over(own.orderBy("last_seen", "concept_id"))
    known = F.row_number().over(own.orderBy(F.when(F.col("review"), 1).otherwise(0), F.desc(F.round("theta", 6)), "concept_id"))
    noisy = F.col("priority") / C.SOFTMAX_T - F.log(-F.log(L.hashed_uniform(F.lit("mix"), F.col("user_id"), F.col("concept_id"))))
    drawn = F.row_number().over(own.orderBy(F.when(F.col("picked"), 1).otherwise(0), F.desc("noisy"), "concept_id"))
    rows = state.withColumn("review", unseen <= 2).withColumn("warm", ~F.col("review") & (known <= 3)).withColumn("picked", F.col("review") | F.col("warm")).withColumn("noisy", noisy).withColumn("d", drawn)
    bucket = F.when(F.col("review"), "review").when(F.col("warm"), "warm-up").when(F.col("d") <= 21, "core").when(F.col("d") <= 25, "mixed")
    return rows.select("user_id", "concept_id", bucket.alias("bucket")).filter("bucket is not null")


def mock_paper(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A paper of up to 100 questions for every course, its chapters' seats filled by a repeatable draw."""
    where = latest_rows(read(spark, sf_dir, "concept_drafts").select("concept_id", "course_id", "chapter_id", "updated_at"), "concept_id", "updated_at").select("concept_id", "chapter_id")
    seats = chapter_seats(spark, sf_dir).select("chapter_id", "seats")
    pool = questions(spark, sf_dir, "course_id", "concept_id", "status").filter("status = 'active'").join(where, "concept_id").join(seats, "chapter_id")
    place = F.row_number().over(Window.partitionBy("chapter_id").orderBy(L.hashed_uniform(F.lit("mock"), F.col("question_id")), "question_id"))
    return pool.withColumn("place", place.cast("long")).filter("place <= seats").select("course_id", "chapter_id", "question_id", "place")


def diagnostic_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One question a difficulty tier for every chapter, of another concept each where there is one."""
    where = latest_rows(read(spark, sf_dir, "concept_drafts").select("concept_id", "chapter_id", "updated_at"), "concept_id", "updated_at").select("concept_id", "chapter_id").filter("chapter_id is not null")
    pool = questions(spark, sf_dir, "concept_id", "difficulty", "status").filter("status = 'active' and difficulty between 1 and 3").join(where, "concept_id")
    used, out = None, None
    for tier in (1, 2, 3):
        own = pool.filter(F.col("difficulty") == tier).withColumn("u", L.hashed_uniform(F.lit("diag"), F.col("question_id")))
        if used is not None:
            own = own.join(used, ["chapter_id", "concept_id"], "left")
        else:
            own = own.withColumn("used", F.lit(None).cast("boolean"))
        best = F.row_number().over(Window.partitionBy("chapter_id").orderBy(F.coalesce(F.col("used").cast("int"), F.lit(0)), "u", "question_id"))
        pick = own.withColumn("b", best).filter("b = 1").select("chapter_id", "concept_id", "question_id", F.lit(tier).alias("tier"))
        marked = pick.select("chapter_id", "concept_id", F.lit(True).alias("used"))
        used = marked if used is None else used.unionByName(marked).distinct()
        out = pick if out is None else out.unionByName(pick)
    return out


def scenario_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every scenario, whether they are within 120 to 220, and its first twenty."""
    rows = read(spark, sf_dir, "extra_caselets_1mark").select("caselet_id", "scenario").dropDuplicates(["caselet_id"]).filter("scenario is not null")
    w = F.filter(F.split("scenario", r"\s+"), lambda x: x != "")
    return rows.select("caselet_id", F.size(w).cast("long").alias("words"), F.size(w).between(120, 220).alias("fits"), F.array_join(F.slice(w, 1, 20), " ").alias("opening"))


def close_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with two options whose words agree to a cosine of 0.85 or more, and the largest cosine."""
    o = questions(spark, sf_dir, "options").select("question_id", F.posexplode("options").alias("i", "o")).select("question_id", "i", F.array_distinct(X.words(F.col("o.text"))).alias("w")).filter(F.size("w") > 0)
    bag = o.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("i", "w"))).alias("bag"))  # an item's options
    pairs = bag.select("question_id", F.explode("bag").alias("a"), "bag").select("question_id", "a", F.explode("bag").alias("b")).filter("a.i < b.i")
    cos = F.size(F.array_intersect("a.w", "b.w")) / F.sqrt(F.size("a.w") * F.size("b.w").cast("double"))
    return pairs.groupBy("question_id").agg(F.round(F.max(cos), 6).alias("cos")).filter("cos >= 0.85")


def session_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far ability moved in each session, by concept."""
    rows = attempts(spark, sf_dir, "session_id", "concept_id", "theta_before", "theta_after").filter("session_id is not null and theta_before is not null")
    return rows.groupBy("session_id", "concept_id").agg(F.round(F.sum(F.col("theta_after") - F.col("theta_before")), 6).alias("delta"), F.count("*").alias("n"))


def bank_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By course: questions, active ones, with four options, with a key among them, with a stem, and mean marks."""
    keys = F.transform("options", lambda o: o["key"])
    return questions(spark, sf_dir, "course_id", "status", "options", "correct_key", "stem", "marks").groupBy("course_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("status") == "active").alias("active"), F.count_if(F.size("options") == 4).alias("four"),
        F.count_if(F.array_contains(keys, F.col("correct_key"))).alias("keyed"), F.count_if(F.trim("stem") != "").alias("stemmed"), F.round(F.avg("marks"), 6).alias("marks"),
    )


def audit_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By course: questions answered 20 times or more, those of them to retire for low discrimination, and how many lack one."""
    d = learning.discrimination(spark, sf_dir).join(questions(spark, sf_dir, "course_id"), "question_id").filter(F.col("n") >= C.DEAD_PULLS)
    return d.groupBy("course_id").agg(F.count("*").alias("judged"), F.count_if(F.col("discrimination") < 0.05).alias("retire"), F.count_if(F.col("discrimination").isNull()).alias("undefined"))


def reviewed_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviewed drafts of every chapter, chapters without any included."""
    d = latest_rows(read(spark, sf_dir, "concept_drafts").select("concept_id", "chapter_id", "review_status", "updated_at"), "concept_id", "updated_at")
    n = d.filter(F.col("review_status").isin("accepted", "edited", "merged")).groupBy("chapter_id").agg(F.count("*").alias("c"))
    return read(spark, sf_dir, "chapters").select("chapter_id", "course_id").join(n, "chapter_id", "left").select("chapter_id", "course_id", F.coalesce("c", F.lit(0).cast("long")).alias("reviewed"))


QUERIES = {f.__name__: f for f in (session_mix, mock_paper, diagnostic_items, scenario_words, close_options, session_deltas, bank_metrics, audit_tally, reviewed_drafts)}

_U = "(('0x' || substr(md5({}), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE"
_SEATS = learning.SQL["chapter_seats"].replace("SELECT course_id, chapter_id, n, (fl", ", seats AS (SELECT chapter_id, (fl").rstrip() + """),
q AS (SELECT DISTINCT ON (question_id) * FROM questions)
"""

SQL = {
    "session_mix": learning._A + learning._PRIO + f""", b AS (
  SELECT s.user_id, s.concept_id, round(s.theta, 6) AS theta, s.seen, priority / 0.7::DOUBLE - ln(-ln({_U.format("'mix|' || user_id || '|' || concept_id")})) AS g FROM state s JOIN prio USING (user_id, concept_id)
), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seen, concept_id) <= 2 AS review FROM b),
k AS (SELECT *, NOT review AND row_number() OVER (PARTITION BY user_id ORDER BY review, theta DESC, concept_id) <= 3 AS warm FROM r),
d AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY review OR warm, g DESC, concept_id) AS d FROM k)
SELECT user_id, concept_id, CASE WHEN review THEN 'review' WHEN warm THEN 'warm-up' WHEN d <= 21 THEN 'core' ELSE 'mixed' END AS bucket FROM d WHERE review OR warm OR d <= 25""",
    "mock_paper": _SEATS + f""", p AS (
  SELECT q.course_id, drafts.chapter_id, question_id, seats, row_number() OVER (PARTITION BY drafts.chapter_id ORDER BY {_U.format("'mock|' || question_id")}, question_id) AS place
  FROM q JOIN drafts USING (concept_id) JOIN seats ON seats.chapter_id = drafts.chapter_id WHERE status = 'active'
) SELECT course_id, chapter_id, question_id, place FROM p WHERE place <= seats""",
    "diagnostic_items": learning._A + f""", p AS (SELECT q.question_id, q.concept_id, d.chapter_id, q.difficulty, {_U.format("'diag|' || q.question_id")} AS u FROM (SELECT DISTINCT ON (question_id) * FROM questions) q JOIN drafts d USING (concept_id)
  WHERE q.status = 'active' AND q.difficulty BETWEEN 1 AND 3 AND d.chapter_id IS NOT NULL),
a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chapter_id ORDER BY u, question_id) AS b FROM p WHERE difficulty = 1) WHERE b = 1),
b AS (SELECT * FROM (SELECT p.*, row_number() OVER (PARTITION BY p.chapter_id ORDER BY (a.concept_id IS NOT NULL)::INT, p.u, p.question_id) AS b FROM p LEFT JOIN a ON a.chapter_id = p.chapter_id AND a.concept_id = p.concept_id WHERE p.difficulty = 2) WHERE b = 1),
ab AS (SELECT DISTINCT chapter_id, concept_id FROM (SELECT chapter_id, concept_id FROM a UNION ALL SELECT chapter_id, concept_id FROM b)),
c AS (SELECT * FROM (SELECT p.*, row_number() OVER (PARTITION BY p.chapter_id ORDER BY (ab.concept_id IS NOT NULL)::INT, p.u, p.question_id) AS b FROM p LEFT JOIN ab ON ab.chapter_id = p.chapter_id AND ab.concept_id = p.concept_id WHERE p.difficulty = 3) WHERE b = 1)
SELECT chapter_id, concept_id, question_id, 1 AS tier FROM a UNION ALL SELECT chapter_id, concept_id, question_id, 2 FROM b UNION ALL SELECT chapter_id, concept_id, question_id, 3 FROM c""",
    "scenario_words": r"""WITH c AS (SELECT DISTINCT ON (caselet_id) caselet_id, list_filter(string_split_regex(scenario, '\s+'), lambda x: x <> '') AS w FROM extra_caselets_1mark WHERE scenario IS NOT NULL)
SELECT caselet_id, len(w)::BIGINT AS words, len(w) BETWEEN 120 AND 220 AS fits, array_to_string(w[1:20], ' ') AS opening FROM c""",
    "close_options": """WITH q AS (SELECT DISTINCT ON (question_id) * FROM questions),
o AS (SELECT question_id, p.i, list_distinct(regexp_extract_all(lower(options[p.i].text), '[a-z0-9]+')) AS w FROM q, LATERAL (SELECT unnest(generate_series(1, len(options))) AS i) p)
SELECT a.question_id, round(max(len(list_intersect(a.w, b.w)) / sqrt(len(a.w) * len(b.w)::DOUBLE)), 6) AS cos FROM o a JOIN o b ON a.question_id = b.question_id AND a.i < b.i
WHERE len(a.w) > 0 AND len(b.w) > 0 GROUP BY a.question_id HAVING round(max(len(list_intersect(a.w, b.w)) / sqrt(len(a.w) * len(b.w)::DOUBLE)), 6) >= 0.85""",
    "session_deltas": learning._A + "SELECT session_id, concept_id, round(sum(theta_after - theta_before), 6) AS delta, count(*) AS n FROM att WHERE session_id IS NOT NULL AND theta_before IS NOT NULL GROUP BY 1, 2",
    "bank_metrics": """WITH q AS (SELECT DISTINCT ON (question_id) * FROM questions)
SELECT course_id, count(*) AS n, count(*) FILTER (WHERE status = 'active') AS active, count(*) FILTER (WHERE len(options) = 4) AS four,
  count(*) FILTER (WHERE list_contains(list_transform(options, lambda o: o.key), correct_key)) AS keyed, count(*) FILTER (WHERE trim(stem) <> '') AS stemmed, round(avg(marks), 6) AS marks FROM q GROUP BY course_id""",
    "audit_tally": learning.SQL["discrimination"].replace("SELECT question_id, n, round(p, 6)", ", dd AS (SELECT question_id, n, round(p, 6)") + """)
SELECT course_id, count(*) AS judged, count(*) FILTER (WHERE discrimination < 0.05) AS retire, count(*) FILTER (WHERE discrimination IS NULL) AS undefined
FROM dd JOIN (SELECT DISTINCT ON (question_id) question_id, course_id FROM questions) c USING (question_id) WHERE n >= 20 GROUP BY course_id""",
    "reviewed_drafts": """WITH d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY concept_id ORDER BY updated_at DESC) AS rn FROM concept_drafts) WHERE rn = 1),
n AS (SELECT chapter_id, count(*) AS c FROM d WHERE review_status IN ('accepted', 'edited', 'merged') GROUP BY 1) SELECT chapter_id, course_id, coalesce(c, 0) AS reviewed FROM chapters LEFT JOIN n USING (chapter_id)""",
}
