"""Problem 5: pairwise matches consolidated into groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradewright.scratch import Scratch
from gradewright.skew import lookup

#: Breadth-first rounds from the highest-degree vertex before the rest is left to label propagation.
MAX_FRONTIERS = 30


def star_links(keys: DataFrame, id_col: str, *key_cols: str) -> DataFrame:
    """(src, dst): each member of a key linked to the key's smallest member, instead of all pairs of a key."""
    scratch = Scratch(keys.sparkSession, "stars")
    keys = scratch.write(keys.select(id_col, *key_cols))  # read three times below
    low = keys.groupBy(*key_cols).agg(F.min(id_col).alias("dst"), F.max(id_col).alias("_hi"), F.count("*").alias("cnt")).filter(F.col("dst") < F.col("_hi"))
    tag = F.xxhash64(*key_cols)
    # The tag only places the rows; the key columns themselves are compared.
    named = scratch.write(low.select(tag.alias("_tag"), *[F.col(c).alias(f"_{c}") for c in key_cols], "dst", "cnt"))
    rows = lookup(keys.withColumn("_tag", tag), named, "_tag")
    for c in key_cols:
        rows = rows.filter(F.col(c) == F.col(f"_{c}"))
    return rows.select(F.col(id_col).alias("src"), "dst").filter("src <> dst")


def consolidate(links: DataFrame, max_frontiers: int = MAX_FRONTIERS) -> DataFrame:
    """(node, group_id) for every node on a link; group_id is the smallest node reachable.

    The vertex of highest degree most likely lies in the giant component. Breadth-first frontiers, each a join with the
    links left (written anew whenever half of the nodes are reached), peel that component; it is anti-joined away and the small components that stay are labelled
    by minimum propagation with shortcuts (a node also takes its label's label), so a chain of n needs about
    log n rounds. Should the first component be so long that its frontiers don't end, what they reached is
    contracted into one vertex and the propagation finishes it: the result is the same.

    Links with a null end are left out; a loop makes its node a group of one; repeated links count once.
    """
    spark = links.sparkSession
    scratch = Scratch(spark, "consolidate")
    src, dst = links.columns[:2]
    pairs = links.select(F.col(src).alias("u"), F.col(dst).alias("v")).dropna()
    ways = F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v"))))
    both = scratch.write(pairs.select(ways.alias("x")).select("x.u", "x.v").distinct())
    degree = scratch.write(both.groupBy("u").count())
    start = degree.orderBy(F.desc("count"), "u").limit(1)

    seen = scratch.write(start.select("u"))
    frontier, rounds = seen, 0
    waves = [seen]
    left, n_left, n_used, done = both, degree.count(), 0, 0
    while rounds < max_frontiers:
        reached = left.join(frontier, "u").select(F.col("v").alias("u")).distinct()
        for wave in waves[-2:]:  # neighbours of a wave lie in it, before it or behind it
            reached = reached.join(wave, "u", "left_anti")
        frontier = scratch.write(reached)
        rounds += 1
        if frontier.isEmpty():
            break
        waves.append(frontier)
        # Links of waves gone by are not read for ever: what is left is written anew whenever half of the nodes left are reached.
        n_used += frontier.count()
        if 2 * n_used > n_left:
            for wave in waves[done:-1]:
                left = left.join(wave, "u", "left_anti")
            left, done = scratch.write(left), len(waves) - 1
            n_left, n_used = n_left - n_used, 0
    else:
        rounds = -1
    giant = waves[0]
    for wave in waves[1:]:
        giant = giant.union(wave)
    giant = scratch.write(giant)
    tagged = giant.withColumn("g", F.lit(giant.agg(F.min("u")).first()[0]).cast(giant.schema["u"].dataType))
    if rounds >= 0:
        rest = scratch.write(both.join(giant, "u", "left_anti"))
        peeled = tagged.select(F.col("u").alias("node"), F.col("g").alias("group_id"))
        return peeled.unionByName(_propagate(rest, scratch))
    # Unfinished: the reached vertices become one.
    as_u, as_v = tagged.select("u", "g"), tagged.select(F.col("u").alias("v"), F.col("g").alias("h"))
    contracted = scratch.write(
        both.join(as_u, "u", "left").join(as_v, "v", "left")
        .select(F.coalesce("g", "u").alias("u"), F.coalesce("h", "v").alias("v")).distinct()
    )
    labels = scratch.write(_propagate(contracted, scratch))
    inner = tagged.select(F.col("u").alias("orig"), F.col("g").alias("node")).join(labels, "node").select(F.col("orig").alias("node"), "group_id")
    return inner.unionByName(labels.join(giant.withColumnRenamed("u", "node"), "node", "left_anti"))


def _propagate(both: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, group_id) by minimum propagation over symmetric links, with shortcuts, until nothing changes."""
    labels = scratch.write(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("label")))
    while True:
        near = (
            both.join(labels.select(F.col("u").alias("v"), F.col("label").alias("far")), "v")
            .groupBy("u").agg(F.min("far").alias("near"))
        )
        # Hooking: what a node learnt also goes to the node that was its label, so whole trees move at once.
        better = labels.join(near, "u").select("u", "label", F.least("label", "near").alias("new"))
        hooks = better.filter("new < label").groupBy(F.col("label").alias("u")).agg(F.min("new").alias("hook"))
        step = better.join(hooks, "u", "left").select("u", "label", F.least("new", F.coalesce("hook", "new")).alias("new"))
        step = scratch.write(step)
        jump = step.select(F.col("u").alias("new"), F.col("new").alias("far"))
        nxt = scratch.write(
            step.join(jump, "new", "left").select("u", F.least("new", F.coalesce("far", "new")).alias("label"), F.col("label").alias("old"))
        )
        changed = not nxt.filter("label < old").isEmpty()
        scratch.drop(step)
        scratch.drop(labels)
        labels = nxt.select("u", "label")
        labels._scratch_path = getattr(nxt, "_scratch_path", None)
        if not changed:
            return labels.select(F.col("u").alias("node"), F.col("label").alias("group_id"))


def draft_matches(drafts: DataFrame, min_keywords: int = 2) -> DataFrame:
    """(src, dst) links whose closure is that of all matches between drafts of one course.

    drafts: one row a concept_id. Titles match if equal after lower-casing and dropping all but a-z and 0-9 (null titles never
    match). Drafts that share a page and two different keywords share a (page, keyword, keyword) key; only keywords
    that several drafts of the course have on that page make keys. Null and blank entries are dropped, doubled
    ones count once. Key groups are linked as stars, never as all pairs.
    """
    if min_keywords != 2:
        raise ValueError("keys are pairs of keywords")
    form = F.regexp_replace(F.lower("title"), "[^a-z0-9]", "")
    titles = drafts.select("course_id", "concept_id", form.alias("form")).filter("form is not null")
    by_title = star_links(titles, "concept_id", "course_id", "form")

    words = F.array_distinct(F.filter(F.transform("keywords", lambda k: F.lower(F.trim(k))), lambda k: k.isNotNull() & (k != "")))
    pages = F.array_distinct(F.filter("source_pages", lambda p: p.isNotNull()))
    spread = (
        drafts.select("course_id", "concept_id", F.explode(pages).alias("page"), words.alias("words"))
        .filter(F.size("words") >= 2).select("course_id", "concept_id", "page", F.explode("words").alias("word"))
    )
    scratch = Scratch(drafts.sparkSession, "matches")
    spread = scratch.write(spread)
    counts = spread.groupBy("course_id", "page", "word").agg(F.count("*").alias("cnt")).filter("cnt > 1")
    tag = F.xxhash64("course_id", "page", "word")
    named = scratch.write(counts.select(tag.alias("_tag"), F.col("course_id").alias("c"), F.col("page").alias("p"), F.col("word").alias("w"), "cnt"))
    kept = lookup(spread.withColumn("_tag", tag), named, "_tag").filter("c = course_id and p = page and w = word")
    own = kept.groupBy("course_id", "page", "concept_id").agg(F.array_sort(F.collect_set("word")).alias("ws")).filter(F.size("ws") >= 2)
    first = own.select("course_id", "page", "concept_id", "ws", F.posexplode("ws").alias("i", "w1"))
    keys = first.select("course_id", "page", "concept_id", "w1", F.explode(F.expr("slice(ws, i + 2, size(ws))")).alias("w2"))
    return by_title.unionByName(star_links(keys, "concept_id", "course_id", "page", "w1", "w2"))
