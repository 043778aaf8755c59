"""Queries on the attempt log: folds, windows, calibration, priorities, sampling, scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradewright import config as C
from gradewright.functions import learning as L
from gradewright.operators import fold
from gradewright.operators.apportion import largest_remainder, softmax_sample
from gradewright.operators.hierarchy import latest_rows
from gradewright.tables import read

_COLUMNS = ["attempt_id", "user_id", "question_id", "concept_id", "session_id", "correct", "confidence", "chosen_key", "theta_before", "theta_after", "q_rating_before", "q_rating_after", "created_at"]


def attempts(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """One row an attempt; repeated rows differ in received_at only."""
    return read(spark, sf_dir, "attempt_outcomes").select("attempt_id", *[c for c in (columns or _COLUMNS) if c != "attempt_id"]).dropDuplicates(["attempt_id"])


def questions(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """One row a question; repeated rows differ in ingested_at only."""
    return read(spark, sf_dir, "questions").select("question_id", *columns).dropDuplicates(["question_id"])


def _pair() -> Window:
    return Window.partitionBy("user_id", "concept_id").orderBy("created_at", "attempt_id")


def attempt_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many attempts each attempt follows, of its learner on its concept and of its question."""
    by_question = Window.partitionBy("question_id").orderBy("created_at", "attempt_id")
    return attempts(spark, sf_dir, "user_id", "concept_id", "question_id", "created_at").select(
        "attempt_id", (F.row_number().over(_pair()) - 1).cast("long").alias("prior_on_concept"), (F.row_number().over(by_question) - 1).cast("long").alias("prior_on_question")
    )


def _latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = attempts(spark, sf_dir, "user_id", "concept_id", "theta_after", "created_at")
    return rows.groupBy("user_id", "concept_id").agg(
        F.max_by("theta_after", F.struct("created_at", "attempt_id")).alias("theta"), F.max("created_at").alias("last_seen"), F.count("*").alias("n")
    )


def latest_theta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each learner's ability on each concept as it stands."""
    return _latest(spark, sf_dir).select("user_id", "concept_id", F.round("theta", 6).alias("theta"), "n")


def last_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each learner last met each question."""
    return attempts(spark, sf_dir, "user_id", "question_id", "created_at").groupBy("user_id", "question_id").agg(
        F.unix_micros(F.max("created_at")).alias("last_seen_us"), F.count("*").alias("n")
    )


def theta_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As-of join: the learner's ability on the concept just before each attempt, by the log itself."""
    before = _pair().rowsBetween(Window.unboundedPreceding, -1)
    return attempts(spark, sf_dir, "user_id", "concept_id", "theta_after", "created_at").select(
        "attempt_id", F.round(F.coalesce(F.last("theta_after", ignorenulls=True).over(before), F.lit(0.0)), 6).alias("theta_as_of")
    )


def misconception_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flag state of every learner and concept after all attempts: 0 none, 1 open, 2 open and once answered surely right."""
    return fold.misconception_fold(attempts(spark, sf_dir, "user_id", "concept_id", "correct", "confidence", "created_at"))


def _factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = attempts(spark, sf_dir, "user_id", "concept_id", "theta_after", "correct", "confidence", "created_at").filter("correct is not null")
    return rows.select("user_id", "concept_id", "attempt_id", "created_at", L.stability_factor(F.col("theta_after"), F.col("correct"), F.col("confidence")).alias("factor"))


def replay_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memory stability of every learner and concept, replayed from the log."""
    done = fold.stability_fold(_factors(spark, sf_dir))
    return done.select("user_id", "concept_id", F.round("stability", 6).alias("stability"), "n")


def diagnostic_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Abilities seeded from the log with a constant rate against fixed question ratings."""
    rows = attempts(spark, sf_dir, "user_id", "concept_id", "correct", "confidence", "created_at", "q_rating_before").withColumnRenamed("q_rating_before", "q")
    return fold.seed_fold(rows).select("user_id", "concept_id", F.round("theta", 6).alias("theta"), "n")


def ability_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Abilities and question ratings after the coupled fold over the whole log."""
    rows = attempts(spark, sf_dir, "user_id", "question_id", "concept_id", "correct", "confidence", "created_at", "q_rating_before")
    first = rows.groupBy("question_id").agg(F.min_by("q_rating_before", F.struct("created_at", "attempt_id")).alias("q_start"))
    joined = rows.drop("q_rating_before").join(first, "question_id")
    return fold.ability_fold(joined).withColumn("rating", F.round("rating", 6))


def confidence_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy by learner and confidence, the days it rests on, and whether attempting pays."""
    rows = attempts(spark, sf_dir, "user_id", "confidence", "correct", "created_at").filter("confidence is not null")
    days = rows.groupBy("user_id").agg(F.count_distinct(F.to_date("created_at")).alias("days"))
    by = rows.groupBy("user_id", "confidence").agg(F.count("*").alias("n"), F.count_if("correct").alias("right"))
    rate = F.col("right") / F.col("n")
    return by.join(days, "user_id").select(
        "user_id", "confidence", "n", "right", F.round(rate, 6).alias("rate"), "days",
        ((F.col("days") >= C.CALIBRATION_DAYS) & (rate > C.NEGATIVE / (1 + C.NEGATIVE))).alias("attempt"),
    )


def mastery_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean mastery by chapter and concept, with chapter totals, in one pass over grouping sets."""
    latest = _latest(spark, sf_dir).select("concept_id", L.mastery(F.col("theta")).alias("m"))
    where = latest_rows(read(spark, sf_dir, "concept_drafts").select("concept_id", "chapter_id", "updated_at"), "concept_id", "updated_at")
    cells = latest.join(where, "concept_id").select("chapter_id", "concept_id", "m")
    return cells.groupingSets([["chapter_id"], ["chapter_id", "concept_id"]], "chapter_id", "concept_id").agg(
        F.round(F.avg("m"), 6).alias("mastery"), F.count("*").alias("n")
    )


def pull_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each option of each question was chosen."""
    return attempts(spark, sf_dir, "question_id", "chosen_key").filter("chosen_key is not null").groupBy("question_id", "chosen_key").agg(F.count("*").alias("pulls"))


def dead_distractors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wrong options that nobody chose although the question was answered often."""
    pulls = pull_histogram(spark, sf_dir)
    busy = pulls.groupBy("question_id").agg(F.sum("pulls").alias("total")).filter(F.col("total") >= C.DEAD_PULLS)
    options = questions(spark, sf_dir, "options", "correct_key").select("question_id", "correct_key", F.explode("options.key").alias("chosen_key")).filter("chosen_key <> correct_key")
    return options.join(busy, "question_id").join(pulls, ["question_id", "chosen_key"], "left_anti").select("question_id", F.col("chosen_key").alias("dead_key"), "total").distinct()


def discrimination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Point-biserial correlation of success and ability for every question; null where it is undefined."""
    rows = attempts(spark, sf_dir, "question_id", "correct", "theta_before").filter("theta_before is not null and correct is not null")
    right = F.col("correct").cast("double")
    agg = rows.groupBy("question_id").agg(
        F.count("*").alias("n"), F.avg(right).alias("p"), F.avg(F.when(F.col("correct"), F.col("theta_before"))).alias("hi"),
        F.avg(F.when(~F.col("correct"), F.col("theta_before"))).alias("lo"), F.stddev_pop("theta_before").alias("sd"),
    )
    r = F.when(F.col("sd") > 1e-9, (F.col("hi") - F.col("lo")) / F.col("sd") * F.sqrt(F.col("p") * (1 - F.col("p"))))
    return agg.select("question_id", "n", F.round("p", 6).alias("p"), F.round(r, 6).alias("discrimination"))


def _priorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Priorities from each state's replayed stability and misconception flag, as in replay_stability and misconception_flags."""
    rows = attempts(spark, sf_dir, "user_id", "concept_id", "theta_after", "created_at", "correct", "confidence")
    now = read(spark, sf_dir, "attempt_outcomes").agg(F.max("created_at")).scalar()
    factor = F.when(F.col("correct").isNotNull(), L.stability_factor(F.col("theta_after"), F.col("correct"), F.col("confidence")))
    state = fold.learner_states(rows.withColumn("factor", factor))
    return state.select("user_id", "concept_id", F.round(L.priority(F.col("theta"), F.col("stability"), L.days_between(now, F.col("seen")), F.col("flag") > 0, F.col("n")), 6).alias("priority"))


def priority_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most urgent concepts of every learner."""
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("priority"), "concept_id"))
    return _priorities(spark, sf_dir).withColumn("place", place.cast("long")).filter("place <= 5")


def softmax_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three concepts a learner, drawn by softmax of their priority."""
    rows = softmax_sample(_priorities(spark, sf_dir), ["user_id"], "priority", 3, [F.col("user_id"), F.col("concept_id")])
    return rows.select("user_id", "concept_id", "slot")


def session_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and best possible score of every session, wrong answers at a quarter off."""
    marks = questions(spark, sf_dir, "marks")
    rows = attempts(spark, sf_dir, "session_id", "question_id", "correct").filter("session_id is not null").join(marks, "question_id")
    gain = F.when(F.col("correct"), F.col("marks")).when(~F.col("correct"), -C.NEGATIVE * F.col("marks")).otherwise(0.0)
    return rows.groupBy("session_id").agg(F.round(F.sum(gain), 6).alias("score"), F.round(F.sum("marks"), 6).alias("out_of"), F.count("*").alias("n"))


def review_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order in which each learner's answers are gone through: sure and wrong first, caselets kept together."""
    rows = attempts(spark, sf_dir, "user_id", "question_id", "correct", "confidence", "created_at").join(questions(spark, sf_dir, "case_group_id", "case_position"), "question_id")
    rank = F.when(~F.col("correct") & (F.col("confidence") == "sure"), 0).when(~F.col("correct"), 1).when(F.col("correct").isNull(), 2).otherwise(3)
    key = F.coalesce(F.concat(F.lit("c"), F.col("case_group_id").cast("string")), F.concat(F.lit("q"), F.col("question_id").cast("string")))
    base = rows.withColumn("r", rank).withColumn("g", key).withColumn("first", F.struct("created_at", "attempt_id"))
    group = Window.partitionBy("user_id", "g")
    placed = base.withColumn("worst", F.min("r").over(group)).withColumn("seen", F.min("first").over(group))
    order = Window.partitionBy("user_id").orderBy("worst", "seen", F.coalesce("case_position", F.lit(0)), "created_at", "attempt_id")
    return placed.select("user_id", "attempt_id", F.row_number().over(order).cast("long").alias("place"))


def expected_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks each learner may expect from the questions met, attempting only what pays."""
    marks = questions(spark, sf_dir, "marks")
    rows = attempts(spark, sf_dir, "user_id", "question_id", "theta_before", "q_rating_before").filter("theta_before is not null and q_rating_before is not null").join(marks, "question_id")
    p = L.logistic(F.col("theta_before") - F.col("q_rating_before"))
    return rows.groupBy("user_id").agg(F.round(F.sum(L.expected_value(p, F.col("marks"))), 4).alias("expected"), F.round(F.sum("marks"), 4).alias("out_of"))


def _width(spark: SparkSession) -> int:
    """Tasks for rows that are few now and many after the draws."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _drawn(items: DataFrame, ability: list[str], answer: list[str], draws: int) -> tuple[DataFrame, Column]:
    """items once a draw b, and the success of each: 1, 0, or null where p(success) is below break-even and the item is skipped.

    items: (theta, se, q). An ability is drawn normally around theta once for the ``ability`` key, an answer once for the ``answer`` key. The
    uniforms are counted from one digest a key, so a draw costs arithmetic only.
    """
    seeds = items.withColumns({"s1": L.seed(F.lit("r"), *map(F.col, ability)), "s2": L.seed(F.lit("a"), *map(F.col, ability)), "s3": L.seed(F.lit("x"), *map(F.col, answer))})
    rows = seeds.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    u = [L.counted_uniform(F.col(c), F.col("b")) for c in ("s1", "s2", "s3")]
    z = F.sqrt(-2 * F.log(u[0])) * F.cos(6.283185307179586 * u[1])
    rows = rows.withColumn("p", L.logistic(F.col("theta") + F.col("se") * z - F.col("q")))
    return rows, F.when(F.col("p") >= C.NEGATIVE / (1 + C.NEGATIVE), F.when(u[2] < F.col("p"), 1).otherwise(0))


def bootstrap_band(spark: SparkSession, sf_dir: str, draws: int = 1000) -> DataFrame:
    """2.5 and 97.5 % points of every learner's score over repeated draws of ability and answers.

    A learner's concepts stay together in 16 parts, so scores are summed before they are shuffled and a learner with a third of the log is split.
    """
    items = attempts(spark, sf_dir, "user_id", "concept_id", "theta_after", "q_rating_before", "created_at").filter("q_rating_before is not null and user_id is not null")
    items = items.withColumn("part", F.pmod(F.xxhash64("concept_id"), F.lit(16))).repartition(_width(spark), "user_id", "part")
    per = Window.partitionBy("user_id", "part", "concept_id")
    last = F.max_by("theta_after", F.struct("created_at", "attempt_id")).over(per)
    items = items.select("user_id", "attempt_id", "concept_id", F.col("q_rating_before").alias("q"), (C.SE_BASE / F.sqrt(1.0 + F.count("*").over(per))).alias("se"), last.alias("theta"))
    rows, right = _drawn(items, ["user_id", "concept_id"], ["user_id", "attempt_id"], draws)
    mark = F.when(right == 1, 1.0).when(right == 0, -C.NEGATIVE).otherwise(0.0)
    totals = rows.groupBy("user_id", "b").agg(F.sum(mark).alias("score"))
    return totals.groupBy("user_id").agg(
        F.round(F.percentile("score", F.lit(C.INTERVAL[0])), 6).alias("low"), F.round(F.percentile("score", F.lit(C.INTERVAL[1])), 6).alias("high"), F.round(F.avg("score"), 6).alias("mean")
    )


def chapter_seats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """100 questions of every course apportioned to its chapters by their number of drafts."""
    drafts = latest_rows(read(spark, sf_dir, "concept_drafts").select("concept_id", "course_id", "chapter_id", "updated_at"), "concept_id", "updated_at")
    counts = drafts.groupBy("course_id", "chapter_id").agg(F.count("*").alias("n")).filter("chapter_id is not null")
    return largest_remainder(counts, ["course_id"], "n", 100, "chapter_id").select("course_id", "chapter_id", "n", "seats")


QUERIES = {
    f.__name__: f
    for f in (
        attempt_index, latest_theta, last_seen, theta_as_of, misconception_flags, replay_stability, diagnostic_seed, ability_states, confidence_calibration, mastery_heatmap,
        pull_histogram, dead_distractors, discrimination, priority_rank, softmax_draw, session_scores, review_order, expected_marks, bootstrap_band, chapter_seats,
    )
}

_A = """WITH RECURSIVE att AS (
  SELECT DISTINCT attempt_id, user_id, question_id, concept_id, session_id, correct, confidence, chosen_key, theta_before, theta_after, q_rating_before, q_rating_after, created_at
  FROM attempt_outcomes
), qs AS (SELECT DISTINCT ON (question_id) question_id, case_group_id, case_position, marks, correct_key, options FROM questions),
drafts AS (SELECT concept_id, course_id, chapter_id FROM (SELECT *, row_number() OVER (PARTITION BY concept_id ORDER BY updated_at DESC) AS rn FROM concept_drafts) WHERE rn = 1)
"""
_W = "CASE WHEN correct THEN CASE confidence WHEN 'sure' THEN 1.0::DOUBLE WHEN 'unsure' THEN 0.7::DOUBLE ELSE 0.25::DOUBLE END ELSE CASE confidence WHEN 'sure' THEN 1.6::DOUBLE WHEN 'unsure' THEN 1.0::DOUBLE ELSE 0.6::DOUBLE END END"
_FLAG = """list_reduce(list_prepend(0, list(CASE WHEN NOT correct AND confidence = 'sure' THEN 10 WHEN NOT correct THEN 12 WHEN confidence = 'sure' THEN 11 ELSE 13 END
    ORDER BY created_at, attempt_id)), lambda s, e: CASE WHEN e = 10 THEN 1 WHEN e = 12 THEN CASE WHEN s > 0 THEN 1 ELSE 0 END WHEN e = 11 THEN CASE s WHEN 1 THEN 2 ELSE 0 END ELSE s END)::INT"""
_STABILITY = "list_reduce(list_prepend(1.0::DOUBLE, list(factor ORDER BY created_at, attempt_id)), lambda s, x: greatest(0.5::DOUBLE, s * x))"
_EV = f""", ev AS (
  SELECT *, {_W} AS w, 1 / (1 + exp(-(theta_after - 0.3::DOUBLE))) AS m FROM att
), f AS (SELECT *, CASE WHEN correct THEN 1 + (1.4::DOUBLE + 0.4::DOUBLE * m - 1) * w ELSE 0.35::DOUBLE / w END AS factor FROM ev)
"""
_PRIO = _EV + f""", now AS (SELECT max(created_at) AS now FROM att),
state AS (
  SELECT user_id, concept_id, arg_max(theta_after, (created_at, attempt_id)) AS theta, max(created_at) AS seen, count(*) AS n, {_FLAG} > 0 AS flag, {_STABILITY} AS stability
  FROM f GROUP BY user_id, concept_id
), prio AS (
  SELECT user_id, concept_id, round(0.45::DOUBLE * (1 - 1 / (1 + exp(-(theta - 0.3::DOUBLE)))) + 0.30::DOUBLE * (1 - exp(-greatest(0.0::DOUBLE, (epoch_us(now) - epoch_us(seen)) / 8.64e10::DOUBLE) / stability))
    + 0.20::DOUBLE * (CASE WHEN flag THEN 1.0 ELSE 0.0 END)::DOUBLE + 0.05::DOUBLE / (1 + n), 6) AS priority
  FROM state, now
)"""

def _seed(text: str) -> str:
    return f"('0x' || substr(md5({text}), 1, 8))::BIGINT"


def _uniform(start: str, n: str) -> str:
    x = f"(({start} + {n} * 2654435769) & 4294967295)"
    for _ in range(2):
        x = f"((xor({x}, {x} >> 16) * 73244475) & 4294967295)"
    return f"((xor({x}, {x} >> 16) + 0.5::DOUBLE) / 4294967296.0::DOUBLE)"


SQL = {
    "attempt_index": _A + """SELECT attempt_id, row_number() OVER (PARTITION BY user_id, concept_id ORDER BY created_at, attempt_id) - 1 AS prior_on_concept,
  row_number() OVER (PARTITION BY question_id ORDER BY created_at, attempt_id) - 1 AS prior_on_question FROM att""",
    "latest_theta": _A + "SELECT user_id, concept_id, round(arg_max(theta_after, (created_at, attempt_id)), 6) AS theta, count(*) AS n FROM att GROUP BY user_id, concept_id",
    "last_seen": _A + "SELECT user_id, question_id, epoch_us(max(created_at)) AS last_seen_us, count(*) AS n FROM att GROUP BY user_id, question_id",
    "theta_as_of": _A + """SELECT attempt_id, round(coalesce(last_value(theta_after IGNORE NULLS) OVER (PARTITION BY user_id, concept_id ORDER BY created_at, attempt_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE), 6) AS theta_as_of FROM att""",
    "misconception_flags": _A + f"SELECT user_id, concept_id, {_FLAG} AS flag FROM att GROUP BY user_id, concept_id",
    "replay_stability": _A + _EV + f"SELECT user_id, concept_id, round({_STABILITY}, 6) AS stability, count(*) AS n FROM f GROUP BY user_id, concept_id",
    "diagnostic_seed": _A + f""", ev AS (
  SELECT user_id, concept_id, created_at, attempt_id, {{'t': 0.0::DOUBLE, 'q': coalesce(q_rating_before, 0.0)::DOUBLE, 'a': CASE WHEN correct THEN 1.0 ELSE 0.0 END::DOUBLE, 'w': ({_W})::DOUBLE}} AS e FROM att
)
SELECT user_id, concept_id, round(list_reduce(list_prepend({{'t': 0.0::DOUBLE, 'q': 0.0::DOUBLE, 'a': 0.0::DOUBLE, 'w': 0.0::DOUBLE}}, list(e ORDER BY created_at, attempt_id)),
  lambda s, x: {{'t': greatest(-6.0::DOUBLE, least(6.0::DOUBLE, s.t + 0.5::DOUBLE * x.w * (x.a - 1 / (1 + exp(-(s.t - x.q)))))), 'q': x.q, 'a': x.a, 'w': x.w}}).t, 6) AS theta, count(*) AS n
FROM ev GROUP BY user_id, concept_id""",
    "confidence_calibration": _A + """, days AS (SELECT user_id, count(DISTINCT created_at::DATE) AS days FROM att WHERE confidence IS NOT NULL GROUP BY user_id),
g AS (SELECT user_id, confidence, count(*) AS n, count(*) FILTER (WHERE correct) AS "right" FROM att WHERE confidence IS NOT NULL GROUP BY user_id, confidence)
SELECT user_id, confidence, n, "right", round("right" / n, 6) AS rate, days, days >= 3 AND "right" / n > 0.2::DOUBLE AS attempt FROM g JOIN days USING (user_id)""",
    "mastery_heatmap": _A + """, latest AS (SELECT user_id, concept_id, arg_max(theta_after, (created_at, attempt_id)) AS theta FROM att GROUP BY user_id, concept_id)
SELECT chapter_id, concept_id, round(avg(1 / (1 + exp(-(theta - 0.3::DOUBLE)))), 6) AS mastery, count(*) AS n
FROM latest JOIN drafts USING (concept_id) GROUP BY GROUPING SETS ((chapter_id), (chapter_id, concept_id))""",
    "pull_histogram": _A + "SELECT question_id, chosen_key, count(*) AS pulls FROM att WHERE chosen_key IS NOT NULL GROUP BY question_id, chosen_key",
    "dead_distractors": _A + """, pulls AS (SELECT question_id, chosen_key, count(*) AS pulls FROM att WHERE chosen_key IS NOT NULL GROUP BY question_id, chosen_key),
busy AS (SELECT question_id, sum(pulls)::BIGINT AS total FROM pulls GROUP BY question_id HAVING sum(pulls) >= 20),
opt AS (SELECT question_id, correct_key, unnest(options).key AS k FROM qs)
SELECT DISTINCT question_id, k AS dead_key, total FROM opt JOIN busy USING (question_id)
WHERE k <> correct_key AND NOT EXISTS (SELECT 1 FROM pulls p WHERE p.question_id = opt.question_id AND p.chosen_key = opt.k)""",
    "discrimination": _A + """, g AS (
  SELECT question_id, count(*) AS n, avg(correct::INT) AS p, avg(theta_before) FILTER (WHERE correct) AS hi, avg(theta_before) FILTER (WHERE NOT correct) AS lo, stddev_pop(theta_before) AS sd
  FROM att WHERE theta_before IS NOT NULL AND correct IS NOT NULL GROUP BY question_id
)
SELECT question_id, n, round(p, 6) AS p, round(CASE WHEN sd > 1e-9 THEN (hi - lo) / sd * sqrt(p * (1 - p)) END, 6) AS discrimination FROM g""",
    "priority_rank": _A + _PRIO + """ SELECT * FROM (SELECT user_id, concept_id, priority, row_number() OVER (PARTITION BY user_id ORDER BY priority DESC, concept_id) AS place FROM prio) WHERE place <= 5""",
    "softmax_draw": _A + _PRIO + """, g AS (
  SELECT user_id, concept_id, priority / 0.7::DOUBLE - ln(-ln((('0x' || substr(md5(coalesce(user_id || '|', '') || concept_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)) AS g FROM prio
) SELECT user_id, concept_id, slot FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY g DESC, concept_id) AS slot FROM g) WHERE slot <= 3""",
    "session_scores": _A + """SELECT session_id, round(sum(CASE WHEN correct THEN marks WHEN NOT correct THEN -0.25::DOUBLE * marks ELSE 0.0 END), 6) AS score, round(sum(marks), 6) AS out_of, count(*) AS n
FROM att JOIN qs USING (question_id) WHERE session_id IS NOT NULL GROUP BY session_id""",
    "review_order": _A + """, b AS (
  SELECT user_id, attempt_id, created_at, case_position, CASE WHEN NOT correct AND confidence = 'sure' THEN 0 WHEN NOT correct THEN 1 WHEN correct IS NULL THEN 2 ELSE 3 END AS r,
    coalesce('c' || case_group_id, 'q' || question_id) AS g FROM att JOIN qs USING (question_id)
), p AS (SELECT *, min(r) OVER (PARTITION BY user_id, g) AS worst, first_value(created_at) OVER w AS seen, first_value(attempt_id) OVER w AS seen_id FROM b WINDOW w AS (PARTITION BY user_id, g ORDER BY created_at, attempt_id))
SELECT user_id, attempt_id, row_number() OVER (PARTITION BY user_id ORDER BY worst, seen, seen_id, coalesce(case_position, 0), created_at, attempt_id) AS place FROM p""",
    "expected_marks": _A + """, p AS (SELECT user_id, marks, 1 / (1 + exp(-(theta_before - q_rating_before))) AS p FROM att JOIN qs USING (question_id) WHERE theta_before IS NOT NULL AND q_rating_before IS NOT NULL)
SELECT user_id, round(sum(CASE WHEN p >= 0.2::DOUBLE THEN p * marks - (1 - p) * 0.25::DOUBLE * marks ELSE 0.0 END), 4) AS expected, round(sum(marks), 4) AS out_of FROM p GROUP BY user_id""",
    "bootstrap_band": _A + f""", it AS (
  SELECT user_id, attempt_id, concept_id, q_rating_before AS q, 1.2::DOUBLE / sqrt(1.0::DOUBLE + count(*) OVER (PARTITION BY user_id, concept_id)) AS se,
    last_value(theta_after) OVER (PARTITION BY user_id, concept_id ORDER BY created_at, attempt_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS theta
  FROM att WHERE q_rating_before IS NOT NULL AND user_id IS NOT NULL
), d AS (SELECT it.*, b, {_seed("'r|' || user_id || '|' || concept_id")} AS s1, {_seed("'a|' || user_id || '|' || concept_id")} AS s2, {_seed("'x|' || user_id || '|' || attempt_id")} AS s3 FROM it, (SELECT unnest(generate_series(1, 1000)) AS b) b),
p AS (SELECT user_id, b, {_uniform("s3", "b")} AS u3, 1 / (1 + exp(-(theta + se * sqrt(-2 * ln({_uniform("s1", "b")})) * cos(6.283185307179586::DOUBLE * {_uniform("s2", "b")}) - q))) AS p FROM d),
t AS (SELECT user_id, b, sum(CASE WHEN p < 0.2::DOUBLE THEN 0.0 WHEN u3 < p THEN 1.0 ELSE -0.25 END)::DOUBLE AS score FROM p GROUP BY user_id, b)
SELECT user_id, round(quantile_cont(score, 0.025), 6) AS low, round(quantile_cont(score, 0.975), 6) AS high, round(avg(score), 6) AS mean FROM t GROUP BY user_id""",
    "chapter_seats": _A + """, c AS (SELECT course_id, chapter_id, count(*) AS n FROM drafts WHERE chapter_id IS NOT NULL GROUP BY course_id, chapter_id),
s AS (SELECT *, n::DOUBLE / sum(n) OVER (PARTITION BY course_id) * 100 AS q FROM c), f AS (SELECT *, floor(q) AS fl FROM s),
r AS (SELECT *, 100 - sum(fl) OVER (PARTITION BY course_id) AS rest, row_number() OVER (PARTITION BY course_id ORDER BY round(q - fl, 9) DESC, chapter_id) AS place FROM f)
SELECT course_id, chapter_id, n, (fl + CASE WHEN place <= rest THEN 1 ELSE 0 END)::BIGINT AS seats FROM r""",
}
