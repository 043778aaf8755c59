"""Queries on embedding vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradewright import config as C
from gradewright.functions.text import distinct_union
from gradewright.operators.hierarchy import latest_rows
from gradewright.operators.vectors import hashed_embedding, near_classes, search
from gradewright.tables import read

#: The stated query set: every row whose id it divides.
EVERY = 20


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 6 nearest vectors of every query vector."""
    rows = _rows(spark, sf_dir)
    found = search(rows.filter(F.col("id") % EVERY == 0), rows, C.BRIDGE_TOP)
    return found.select("query_id", "id", F.round("cos", 5).alias("cos"), "rank")


def vector_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest vectors above a threshold, as a bridge table. The tables' largest cosines lie near 0.5, so the threshold is 0.35 here."""
    rows = _rows(spark, sf_dir)
    found = search(rows.filter(F.col("id") % EVERY == 0), rows, C.BRIDGE_TOP, 0.35)
    return found.select("query_id", "id", F.round("cos", 5).alias("cos"))


def vector_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each query vector tagged by its nearest: duplicate, variant or distinct."""
    rows = _rows(spark, sf_dir)
    best = search(rows.filter(F.col("id") % EVERY == 0), rows, 1)
    tag = F.when(F.col("cos") >= C.DUPLICATE_COS, "duplicate").when(F.col("cos") >= C.VARIANT_COS, "variant").otherwise("distinct")
    return best.select("query_id", "id", F.round("cos", 5).alias("cos"), tag.alias("tag"))


def vector_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class and number of links of every vector."""
    return near_classes(_rows(spark, sf_dir), C.VARIANT_COS)


def vector_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By label: vectors, their dimension, and the mean length."""
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return read(spark, sf_dir, "embeddings").groupBy("label").agg(
        F.count("*").alias("n"), F.min(F.size("embedding")).cast("long").alias("least_dim"), F.max(F.size("embedding")).cast("long").alias("most_dim"), F.round(F.avg(norm), 4).alias("length")
    )


#: Cells of the hashed vectors of texts.
DIM = 64


def _text_vectors(df: DataFrame, *columns: str) -> DataFrame:
    return df.filter("text is not null").withColumn("embedding", hashed_embedding(DIM)("text")).select("id", "embedding", *columns)


def _concepts(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    d = latest_rows(read(spark, sf_dir, "concept_drafts").select("concept_id", "updated_at", "title", "description", *columns), "concept_id", "updated_at")
    return d.withColumn("id", F.col("concept_id")).withColumn("text", F.concat_ws(" ", "title", "description"))


def _chunks(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    c = latest_rows(read(spark, sf_dir, "chunks").select("chunk_id", "created_at", "content", *columns), "chunk_id", "created_at")
    return c.select(F.col("chunk_id").alias("id"), F.col("content").alias("text"), *columns)


def concept_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 6 chunks of a concept's own chapter that lie nearest to its title and description."""
    concepts = _text_vectors(_concepts(spark, sf_dir, "chapter_id").filter(F.col("id") % EVERY == 0), "chapter_id")
    found = search(concepts, _text_vectors(_chunks(spark, sf_dir, "chapter_id"), "chapter_id"), C.BRIDGE_TOP, within="chapter_id", same_ids=False)
    return found.select(F.col("query_id").alias("concept_id"), F.col("id").alias("chunk_id"), F.round("cos", 5).alias("cos"), "rank")


def stem_lifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest chunk of the course to every stem, and whether the stem is too close to it."""
    q = read(spark, sf_dir, "questions").select("question_id", "course_id", "stem").dropDuplicates(["question_id"])
    stems = _text_vectors(q.filter(F.col("question_id") % EVERY == 0).select(F.col("question_id").alias("id"), F.col("stem").alias("text"), "course_id"), "course_id")
    found = search(stems, _text_vectors(_chunks(spark, sf_dir, "course_id"), "course_id"), 1, within="course_id", same_ids=False)
    return found.select(F.col("query_id").alias("question_id"), F.col("id").alias("chunk_id"), F.round("cos", 5).alias("cos"), (F.col("cos") >= C.LIFT_COS).alias("lifted"))


def stem_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stem's class of duplicates within its course, by vectors of its words, and how many stems it is a duplicate of."""
    q = read(spark, sf_dir, "questions").select("question_id", "course_id", "stem").dropDuplicates(["question_id"])
    rows = _text_vectors(q.select(F.col("question_id").alias("id"), F.col("stem").alias("text"), "course_id"), "course_id")
    return near_classes(rows, C.DUPLICATE_COS, within="course_id").withColumnRenamed("id", "question_id")


def merged_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drafts of a course whose vectors lie near each other merged: the smallest id stands for all, its arrays first and then those of the others, each entry once."""
    d = _concepts(spark, sf_dir, "course_id", "keywords", "source_pages")
    classes = near_classes(_text_vectors(d.filter("course_id is not null"), "course_id"), C.MERGE_COS, within="course_id").select(F.col("id").alias("concept_id"), "class_id")
    own = d.join(classes, "concept_id").groupBy("class_id")
    one = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("concept_id", F.col(c).alias("x")))), lambda s: s["x"])
    out = own.agg(F.count("*").alias("drafts"), one("keywords").alias("k"), one("source_pages").alias("p"))
    return out.select(
        F.col("class_id").alias("concept_id"), "drafts", F.array_join(distinct_union(F.col("k")), "|").alias("keywords"),
        F.array_join(F.transform(distinct_union(F.col("p")), lambda x: x.cast("string")), "|").alias("pages"),
    )


QUERIES = {f.__name__: f for f in (vector_topk, vector_bridge, vector_variants, vector_classes, vector_labels, concept_chunks, stem_lifts, stem_tags, merged_concepts)}

_V = """WITH RECURSIVE v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
c AS (SELECT q.id AS query_id, r.id AS id, list_cosine_similarity(q.e, r.e) AS cos FROM v q JOIN v r ON q.id <> r.id WHERE q.id % 20 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cos DESC, id) AS rank FROM c)
"""

_WORDS = r"""WITH RECURSIVE dr AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY concept_id ORDER BY updated_at DESC) AS rn FROM concept_drafts) WHERE rn = 1),
ch AS (SELECT DISTINCT ON (chunk_id) * FROM chunks ORDER BY chunk_id, created_at DESC), qs AS (SELECT DISTINCT ON (question_id) question_id, course_id, stem FROM questions),
texts AS (
  SELECT 'd' AS kind, concept_id AS id, course_id, chapter_id, concat_ws(' ', title, description) AS text FROM dr
  UNION ALL SELECT 'c', chunk_id, course_id, chapter_id, content FROM ch UNION ALL SELECT 'q', question_id, course_id, NULL, stem FROM qs
), w AS (SELECT kind, id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM texts),
v AS (SELECT kind, id, ('0x' || substr(md5(w), 1, 8))::BIGINT % 64 AS cell, count(*)::DOUBLE AS x FROM w GROUP BY 1, 2, 3),
len AS (SELECT kind, id, sqrt(sum(x * x)) AS len FROM v GROUP BY 1, 2),
"""
_COS = """cs AS (
  SELECT p.a, p.b, coalesce(sum(x.x * y.x) / any_value(la.len * lb.len), 0.0) AS cos
  FROM p JOIN v x ON x.kind = p.ka AND x.id = p.a JOIN v y ON y.kind = p.kb AND y.id = p.b AND y.cell = x.cell
  JOIN len la ON la.kind = p.ka AND la.id = p.a JOIN len lb ON lb.kind = p.kb AND lb.id = p.b GROUP BY p.a, p.b
)"""
_CLASSES = """, l AS (SELECT a AS x, b AS y FROM cs WHERE cos >= {least}), r AS (SELECT id, id AS o FROM ids UNION SELECT r.id, l.y FROM r JOIN l ON l.x = r.o),
n AS (SELECT x AS id, count(*) AS links FROM l GROUP BY x), cls AS (SELECT id, min(o) AS class_id, coalesce(any_value(links), 0)::BIGINT AS links FROM r LEFT JOIN n USING (id) GROUP BY id)
"""

SQL = {
    "concept_chunks": _WORDS + "p AS (SELECT 'd' AS ka, d.id AS a, 'c' AS kb, c.id AS b FROM texts d JOIN texts c ON d.kind = 'd' AND c.kind = 'c' AND d.chapter_id = c.chapter_id AND c.text IS NOT NULL WHERE d.id % 20 = 0), " + _COS
    + """, k AS (SELECT p.a, p.b, coalesce(cos, 0.0) AS cos, row_number() OVER (PARTITION BY p.a ORDER BY coalesce(cos, 0.0) DESC, p.b) AS rank FROM p LEFT JOIN cs USING (a, b))
SELECT a AS concept_id, b AS chunk_id, round(cos, 5) AS cos, rank FROM k WHERE rank <= 6""",
    "stem_lifts": _WORDS + "p AS (SELECT 'q' AS ka, q.id AS a, 'c' AS kb, c.id AS b FROM texts q JOIN texts c ON q.kind = 'q' AND c.kind = 'c' AND q.course_id = c.course_id AND c.text IS NOT NULL WHERE q.id % 20 = 0 AND q.text IS NOT NULL), " + _COS
    + """, k AS (SELECT p.a, p.b, coalesce(cos, 0.0) AS cos, row_number() OVER (PARTITION BY p.a ORDER BY coalesce(cos, 0.0) DESC, p.b) AS rank FROM p LEFT JOIN cs USING (a, b))
SELECT a AS question_id, b AS chunk_id, round(cos, 5) AS cos, cos >= 0.90 AS lifted FROM k WHERE rank = 1""",
    "stem_tags": _WORDS + "ids AS (SELECT id FROM texts WHERE kind = 'q' AND text IS NOT NULL AND course_id IS NOT NULL), p AS (SELECT 'q' AS ka, x.id AS a, 'q' AS kb, y.id AS b FROM texts x JOIN texts y ON x.kind = 'q' AND y.kind = 'q' AND x.course_id = y.course_id AND x.id <> y.id), "
    + _COS + _CLASSES.format(least=0.90) + "SELECT id AS question_id, class_id, links FROM cls",
    "merged_concepts": _WORDS + "ids AS (SELECT id FROM texts WHERE kind = 'd' AND course_id IS NOT NULL), p AS (SELECT 'd' AS ka, x.id AS a, 'd' AS kb, y.id AS b FROM texts x JOIN texts y ON x.kind = 'd' AND y.kind = 'd' AND x.course_id = y.course_id AND x.id <> y.id), "
    + _COS + _CLASSES.format(least=0.92) + """, m AS (SELECT class_id, concept_id, keywords, source_pages FROM dr JOIN cls ON cls.id = dr.concept_id),
k AS (SELECT class_id, concept_id, unnest(keywords) AS k, generate_subscripts(keywords, 1) AS i FROM m), k1 AS (SELECT class_id, k, min((concept_id, i)) AS seen FROM k WHERE k IS NOT NULL GROUP BY 1, 2),
g AS (SELECT class_id, concept_id, unnest(source_pages) AS p, generate_subscripts(source_pages, 1) AS i FROM m), g1 AS (SELECT class_id, p, min((concept_id, i)) AS seen FROM g WHERE p IS NOT NULL GROUP BY 1, 2)
SELECT class_id AS concept_id, count(*) AS drafts, coalesce((SELECT string_agg(k, '|' ORDER BY seen) FROM k1 WHERE k1.class_id = m.class_id), '') AS keywords,
  coalesce((SELECT string_agg(p::VARCHAR, '|' ORDER BY seen) FROM g1 WHERE g1.class_id = m.class_id), '') AS pages FROM m GROUP BY class_id""",
    "vector_topk": _V + "SELECT query_id, id, round(cos, 5) AS cos, rank FROM k WHERE rank <= 6",
    "vector_bridge": _V + "SELECT query_id, id, round(cos, 5) AS cos FROM k WHERE rank <= 6 AND cos >= 0.35",
    "vector_variants": _V + "SELECT query_id, id, round(cos, 5) AS cos, CASE WHEN cos >= 0.90 THEN 'duplicate' WHEN cos >= 0.83 THEN 'variant' ELSE 'distinct' END AS tag FROM k WHERE rank = 1",
    "vector_classes": """WITH RECURSIVE v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
l AS (SELECT a.id AS x, b.id AS y FROM v a JOIN v b ON a.id <> b.id WHERE list_cosine_similarity(a.e, b.e) >= 0.83),
r AS (SELECT id, id AS o FROM v UNION SELECT r.id, l.y FROM r JOIN l ON l.x = r.o),
n AS (SELECT x AS id, count(*) AS links FROM l GROUP BY x)
SELECT id, min(o) AS class_id, coalesce(any_value(links), 0)::BIGINT AS links FROM r LEFT JOIN n USING (id) GROUP BY id""",
    "vector_labels": """SELECT label, count(*) AS n, min(len(embedding)) AS least_dim, max(len(embedding)) AS most_dim,
  round(avg(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)))), 4) AS length FROM embeddings GROUP BY label""",
}
