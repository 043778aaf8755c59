"""Chapters and sections recovered from the lines of a document, and the gate they must pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CHAPTER = r"(?i)^\s*(?:chapter|unit)\s+(\d+)\s*[:.\-]\s*(.+?)\s*$"
SECTION = r"^\s*(\d+)\.(\d+)\s+(\S.*?)\s*$"
MIN_COVERAGE = 0.95


def headings(lines: DataFrame) -> DataFrame:
    """(source_id, level, chapter_no, section_no, title, page_number, line_no): the first line that heads each chapter or section.

    lines: (source_id, page_number, line_no, text). Lines with four dots in a row belong to a table of contents. Null texts are passed over.
    """
    text = F.col("text")
    base = lines.filter(~text.contains("....")).select(
        "source_id", "page_number", "line_no",
        F.regexp_extract(text, CHAPTER, 1).alias("c"), F.regexp_extract(text, CHAPTER, 2).alias("ct"),
        F.regexp_extract(text, SECTION, 1).alias("s1"), F.regexp_extract(text, SECTION, 2).alias("s2"), F.regexp_extract(text, SECTION, 3).alias("st"),
    ).filter("c <> '' or s1 <> ''")
    level = F.when(F.col("c") != "", "chapter").otherwise("section")
    found = base.select(
        "source_id", level.alias("level"), F.when(F.col("c") != "", F.col("c")).otherwise(F.col("s1")).try_cast("int").alias("chapter_no"), F.col("s2").try_cast("int").alias("section_no"),
        F.when(F.col("c") != "", F.col("ct")).otherwise(F.col("st")).alias("title"), "page_number", "line_no",
    )
    first = F.row_number().over(Window.partitionBy("source_id", "level", "chapter_no", "section_no").orderBy("page_number", "line_no"))
    return found.withColumn("_r", first).filter("_r = 1").drop("_r")


def spans(heads: DataFrame, page_counts: DataFrame) -> DataFrame:
    """heads with page_end: up to the page before the next head of the level, never before its own start; the last goes to the last page.

    page_counts: (source_id, last_page). A section also ends with its chapter.
    """
    order = Window.partitionBy("source_id", "level").orderBy("page_number", "line_no")
    ended = heads.join(page_counts, "source_id").withColumn("_next", F.lead("page_number").over(order))
    ended = ended.withColumn("page_end", F.greatest("page_number", F.coalesce(F.col("_next") - 1, "last_page"))).drop("_next")
    chapters = ended.filter("level = 'chapter'").select("source_id", "chapter_no", F.col("page_end").alias("_ce"))
    return ended.join(chapters, ["source_id", "chapter_no"], "left").withColumn(
        "page_end", F.when(F.col("level") == "section", F.greatest("page_number", F.least("page_end", F.coalesce("_ce", "page_end")))).otherwise(F.col("page_end"))
    ).drop("_ce", "last_page")


def structure_gate(chapters: DataFrame, page_counts: DataFrame, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """(source_id, chapters, overlaps, coverage, passes): whether chapters follow each other without overlap and cover the pages."""
    order = Window.partitionBy("source_id").orderBy("page_number", "line_no")
    marked = chapters.filter("level = 'chapter'").withColumn("_o", F.coalesce(F.lag("page_end").over(order) >= F.col("page_number"), F.lit(False)))
    sums = marked.groupBy("source_id").agg(F.count("*").alias("chapters"), F.count_if("_o").alias("overlaps"), F.min("page_number").alias("_first"))
    covered = marked.select("source_id", F.explode(F.sequence("page_number", "page_end")).alias("p")).groupBy("source_id").agg(F.count_distinct("p").alias("_n"))
    out = page_counts.join(sums, "source_id", "left").join(covered, "source_id", "left")
    share = F.coalesce(F.col("_n") / F.col("last_page"), F.lit(0.0))
    return out.select(
        "source_id", F.coalesce("chapters", F.lit(0).cast("long")).alias("chapters"), F.coalesce("overlaps", F.lit(0).cast("long")).alias("overlaps"), F.round(share, 6).alias("coverage"),
        (F.coalesce(F.col("chapters") > 0, F.lit(False)) & (F.coalesce("overlaps", F.lit(0)) == 0) & (F.coalesce("_first", F.lit(0)) >= 1) & (share >= min_coverage)).alias("passes"),
    )
