"""Queries on concept hierarchies (problem 2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradewright.operators.hierarchy import descendants, hierarchy, latest_rows, prerequisite_parents
from gradewright.tables import read


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    drafts = latest_rows(
        read(spark, sf_dir, "concept_drafts").select("concept_id", "course_id", "title", "prerequisites", "updated_at"),
        "concept_id", "updated_at",
    )
    return hierarchy(prerequisite_parents(drafts))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per draft: root, depth, path and state in the prerequisite hierarchy."""
    tree = _tree(spark, sf_dir)
    return tree.select(
        F.col("id").alias("concept_id"), F.col("root").alias("root_id"), "depth",
        F.when(F.col("node_state") == "tree", F.array_join(F.transform("path", lambda x: x.cast("string")), ">")).otherwise("").alias("id_path"),
        "node_state",
    )


def p2_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (ancestor, descendant) pair with its distance."""
    return descendants(_tree(spark, sf_dir))


def p2_back_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links that close a cycle: concept and the prerequisite that leads back."""
    tree = _tree(spark, sf_dir)
    return tree.filter("back_edge").select(F.col("id").alias("concept_id"), F.col("parent").alias("parent_id"), F.col("root").alias("cycle_id"))


QUERIES = {"p2_found": p2_found, "p2_descendants": p2_descendants, "p2_back_edges": p2_back_edges}

_LINKS = r"""
WITH RECURSIVE latest AS (
  SELECT concept_id, course_id, title, prerequisites FROM (
    SELECT *, row_number() OVER (PARTITION BY concept_id ORDER BY updated_at DESC) AS rn FROM concept_drafts WHERE concept_id IS NOT NULL
  ) WHERE rn = 1
), named AS (
  SELECT concept_id, course_id, trim(regexp_replace(lower(title), '\s+', ' ', 'g')) AS form FROM latest
), asked AS (
  SELECT concept_id, course_id, p.pos, trim(regexp_replace(lower(prerequisites[p.pos]), '\s+', ' ', 'g')) AS form
  FROM latest, LATERAL (SELECT unnest(generate_series(1, len(prerequisites))) AS pos) p
), hits AS (
  SELECT a.concept_id, a.pos, min(n.concept_id) AS parent
  FROM asked a JOIN named n ON n.course_id = a.course_id AND n.form = a.form AND n.concept_id <> a.concept_id
  GROUP BY a.concept_id, a.pos
), links AS (
  SELECT l.concept_id AS id, (SELECT arg_min(h.parent, h.pos) FROM hits h WHERE h.concept_id = l.concept_id) AS parent FROM latest l
), up AS (
  SELECT id, id AS here, parent AS nxt, 0 AS steps, [id] AS seen, false AS closed FROM links
  UNION ALL
  SELECT u.id, u.nxt, k.parent, u.steps + 1, list_append(u.seen, u.nxt), list_contains(u.seen, u.nxt)
  FROM up u JOIN links k ON k.id = u.nxt WHERE NOT u.closed
), last AS (
  SELECT id, here, steps, seen, closed FROM up WHERE closed OR nxt IS NULL
), placed AS (
  SELECT id, here, steps, seen, closed,
    CASE WHEN closed THEN list_min(list_slice(seen, list_position(seen, here), len(seen) - 1)) END AS low,
    CASE WHEN NOT closed THEN 'tree' WHEN here = id THEN 'cycle' ELSE 'below_cycle' END AS node_state
  FROM last
)
"""

SQL = {
    "p2_found": _LINKS + """
SELECT id AS concept_id, CASE WHEN closed THEN low ELSE here END AS root_id,
  CASE WHEN closed THEN -1 ELSE steps END::BIGINT AS depth,
  CASE WHEN closed THEN '' ELSE array_to_string(list_reverse(seen), '>') END AS id_path, node_state
FROM placed""",
    "p2_descendants": _LINKS + """
, ring AS (SELECT id FROM placed WHERE node_state = 'cycle')
SELECT u.here AS ancestor_id, u.id AS descendant_id, u.steps::BIGINT AS distance
FROM up u WHERE u.steps > 0 AND NOT u.closed
  AND u.here NOT IN (SELECT id FROM ring) AND u.id NOT IN (SELECT id FROM ring)""",
    "p2_back_edges": _LINKS + """
SELECT p.id AS concept_id, k.parent AS parent_id, p.low AS cycle_id
FROM placed p JOIN links k ON k.id = p.id WHERE p.node_state = 'cycle' AND k.parent = p.low""",
}
