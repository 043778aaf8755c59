"""Queries of the training-data operators, over whole tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradewright.llm.consolidate import consolidate, draft_matches
from gradewright.llm.leakage import RUN, leaks
from gradewright.llm.neardup import NearDuplicates
from gradewright.llm.packing import CAPACITY, count_tokens, pack
from gradewright.llm.ranking import rank_questions
from gradewright.llm.spans import SharedSpans
from gradewright.llm.scans import ScannedPages
from gradewright.llm.spam import spam_scores
from gradewright.llm.splitting import split_oversized
from gradewright.llm.sql import SQL
from gradewright.operators.hierarchy import latest_rows
from gradewright.tables import read


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [("chunks", "chunk_id", "content"), ("extra_caselets_1mark", "caselet_id", "scenario"), ("questions", "question_id", "stem")]
    return reduce(
        DataFrame.unionByName,
        (read(spark, sf_dir, t).select(F.lit(t).alias("rec_table"), F.col(k).alias("rec_id"), F.col(c).alias("text")) for t, k, c in parts),
    )


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The maximal stretches of words of each record that also stand in another."""
    return SharedSpans(_records(spark, sf_dir)).stretches()


def p1_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of every record stands elsewhere."""
    return SharedSpans(_records(spark, sf_dir)).share()


def p1_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The compacted passages and how widely they stand."""
    return SharedSpans(_records(spark, sf_dir)).passages()


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = read(spark, sf_dir, "chunks").select("chunk_id", "content", "page_start", "page_end", "created_at")
    return split_oversized(latest_rows(chunks, "chunk_id", "created_at"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks that had to be split."""
    return _pieces(spark, sf_dir).filter("piece_no = 0").select("chunk_id")


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every oversized chunk."""
    return _pieces(spark, sf_dir)


def _near(spark: SparkSession, sf_dir: str) -> NearDuplicates:
    parts = [("questions", "question_id", "stem"), ("extra_caselets_1mark", "caselet_id", "scenario")]
    rows = [read(spark, sf_dir, t).select(F.lit(t).alias("scope"), F.col(k).alias("id"), F.col(c).alias("text")) for t, k, c in parts]
    return NearDuplicates(reduce(DataFrame.unionByName, rows))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of stems and of scenarios with a similarity of 0.6 or more."""
    return _near(spark, sf_dir).pairs().withColumnRenamed("scope", "rec_table")


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group and number of links of every stem and scenario."""
    return _near(spark, sf_dir).groups().withColumnsRenamed({"scope": "rec_table", "id": "rec_id"})


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of every concept draft that matches another, directly or through others."""
    drafts = latest_rows(
        read(spark, sf_dir, "concept_drafts").select("concept_id", "course_id", "title", "keywords", "source_pages", "updated_at"), "concept_id", "updated_at"
    )
    groups = consolidate(draft_matches(drafts))
    return groups.select(F.col("node").alias("concept_id"), "group_id")


def p6_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All questions by strength, with standard errors and component checks."""
    attempts = read(spark, sf_dir, "attempt_outcomes").select("attempt_id", "user_id", "question_id", "correct", "theta_before", "q_rating_before")
    return rank_questions(attempts)


def _scans(spark: SparkSession, sf_dir: str) -> ScannedPages:
    pages = read(spark, sf_dir, "parsed_pages").select("page_id", "source_id", "page_number", "text")
    return ScannedPages(pages, read(spark, sf_dir, "parse_results").select("source_id", "headers", "footers"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running lines, broken words and misread words of all pages, with their repair."""
    return _scans(spark, sf_dir).defects()


def p7_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The readable paragraphs of all pages."""
    return _scans(spark, sf_dir).paragraphs()


def p8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of every document, or of its parts if it is larger than one."""
    return pack(count_tokens(read(spark, sf_dir, "documents")))


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of containers, tokens and the share of the space used."""
    used = p8_packing(spark, sf_dir).filter("container_id is not null").groupBy("container_id").agg(F.sum("n_tokens").alias("n"))
    return used.agg(F.count("*").alias("containers"), F.sum("n").alias("tokens"), (F.sum("n") / F.count("*") / CAPACITY).alias("used"))


def _leaks(spark: SparkSession, sf_dir: str, edited: bool = True) -> DataFrame:
    return leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "eval_items"), edited=edited)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a verbatim run of an item."""
    return _leaks(spark, sf_dir, edited=False).filter(F.col("longest_run") >= RUN).select("doc_id", "item_id")


def p9_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that give an item away, edited copies included, with their alignment."""
    return _leaks(spark, sf_dir)


def p9_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leaked items: in how many documents, and how much of the item at most."""
    return _leaks(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("n_docs"), F.max("share").alias("most_share"), F.max("longest_run").alias("longest_run"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are mostly keywords, links or tags."""
    return p10_scores(spark, sf_dir).filter("spam").select("doc_id")


def p10_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scores of every document."""
    return spam_scores(read(spark, sf_dir, "documents"))


__all__ = ["QUERIES", "SQL"]

QUERIES = {f.__name__: f for f in (p1_found, p1_share, p1_passages, p3_found, p3_pieces, p4_found, p4_groups, p5_found, p6_ranking, p7_found, p7_paragraphs, p8_packing, p8_fill, p9_found, p9_leaks, p9_items, p10_found, p10_scores)}
