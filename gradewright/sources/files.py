"""File sources: manifests, registered files, authored JSON, page text, prompt templates."""

from __future__ import annotations

import json
import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_OPTION = "struct<key:string,text:string,misconception:string>"
_QUESTION = f"stem:string,options:array<{_OPTION}>,correct_key:string,explanation:string,difficulty:int"
AUTHORED = (
    "chapter_ordinal int, chapter_title string, "
    f"concepts array<struct<title:string,description:string,difficulty:int,prerequisites:array<string>,keywords:array<string>,misconceptions:array<string>,source_pages:array<string>,questions:array<struct<{_QUESTION}>>>>, "
    f"caselets array<struct<scenario:string,concept_titles:array<string>,questions:array<struct<{_QUESTION},case_position:int,marks:double>>>>, _broken string"
)


def load_manifest(path: str) -> dict:
    """A course manifest (JSON, or YAML where its reader is installed), checked as a whole; ValueError lists every fault."""
    raw = Path(path).read_text(encoding="utf-8")
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as e:
            raise ValueError("YAML manifests need a YAML reader") from e
        data = yaml.safe_load(raw)
    else:
        data = json.loads(raw)
    faults = manifest_faults(data)
    if faults:
        raise ValueError("; ".join(faults))
    return data


def manifest_faults(data: dict) -> list[str]:
    """Faults of a manifest: sources, page offsets, marks of the sections against the total, weights that should sum to one."""
    out = []
    sources = data.get("sources") or []
    if not sources:
        out.append("no sources")
    out += [f"negative page_offset in {s.get('path')}" for s in sources if (s.get("page_offset") or 0) < 0]
    exam = data.get("exam") or {}
    sections = exam.get("sections") or []
    total = exam.get("total")
    marks = sum((s.get("groups") or 1) * (s.get("questions") or 0) * (s.get("marks") or 0) for s in sections)
    if sections and total is not None and abs(marks - total) > 1e-9:
        out.append(f"sections give {marks:g} marks, total is {total:g}")
    if total is not None and (exam.get("passing") or 0) > total:
        out.append("passing above total")
    weights = (data.get("blueprint") or {}).get("overrides") or {}
    if weights and abs(sum(weights.values()) - 1) > 1e-6:
        out.append("overrides do not sum to 1")
    return out


def registered_files(spark: SparkSession, path: str, known: DataFrame | None = None) -> DataFrame:
    """(path, sha256, n_bytes, modified, state) of all files below a path: new, repeated (an earlier path has the content) or known.

    known has a sha256 column. Contents are hashed where they are read; only digests are shuffled.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    rows = files.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("n_bytes"), F.col("modificationTime").alias("modified"))
    first = rows.groupBy("sha256").agg(F.min("path").alias("first_path"))
    out = rows.join(first, "sha256")
    if known is not None:
        out = out.join(known.select("sha256", F.lit(True).alias("_known")).distinct(), "sha256", "left")
    else:
        out = out.withColumn("_known", F.lit(None).cast("boolean"))
    state = F.when(F.col("_known"), "known").when(F.col("path") != F.col("first_path"), "repeated").otherwise("new")
    return out.select("path", "sha256", "n_bytes", "modified", state.alias("state"))


def read_authored(spark: SparkSession, path: str) -> DataFrame:
    """One row a file of authored JSON, with its path; _broken holds the text of a file that is not valid JSON of that form."""
    schema = T._parse_datatype_string(AUTHORED)
    return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken").json(path).withColumn("path", F.input_file_name())


def authored_questions(files: DataFrame) -> DataFrame:
    """(path, chapter_ordinal, kind, owner, position, marks, stem, options, correct_key, difficulty): all questions of valid files.

    source_pages and other loose values are left to their readers; difficulty defaults to 2 outside 1 to 3.
    """
    good = files.filter("_broken is null")
    level = lambda c: F.when(c.between(1, 3), c).otherwise(2)
    concept = good.select("path", "chapter_ordinal", F.explode("concepts").alias("c")).select("path", "chapter_ordinal", F.lit("concept").alias("kind"), F.col("c.title").alias("owner"), F.posexplode("c.questions").alias("position", "q"))
    concept = concept.select("path", "chapter_ordinal", "kind", "owner", "position", F.lit(1.0).alias("marks"), "q.stem", "q.options", "q.correct_key", level(F.col("q.difficulty")).alias("difficulty"))
    case = good.select("path", "chapter_ordinal", F.explode("caselets").alias("c")).select("path", "chapter_ordinal", F.lit("caselet").alias("kind"), F.col("c.scenario").alias("owner"), F.posexplode("c.questions").alias("i", "q"))
    case = case.select(
        "path", "chapter_ordinal", "kind", "owner", F.coalesce("q.case_position", F.col("i") + 1).alias("position"), F.coalesce("q.marks", F.lit(1.0)).alias("marks"),
        "q.stem", "q.options", "q.correct_key", level(F.col("q.difficulty")).alias("difficulty"),
    )
    return concept.unionByName(case)


def rejected_files(files: DataFrame) -> DataFrame:
    """(path, reason) of files left out as a whole."""
    return files.filter("_broken is not null").select("path", F.lit("not valid authored JSON").alias("reason"))


def whole_numbers(values) -> F.Column:
    """An array of loose values as whole numbers; what is none is dropped."""
    return F.filter(F.transform(values, lambda v: F.expr("cast(null as int)") if v is None else F.trim(v).try_cast("int")), lambda v: v.isNotNull())


def read_page_text(spark: SparkSession, path: str) -> DataFrame:
    """(path, page_number, text, char_count, needs_ocr) from text files whose pages are parted by form feeds.

    A page of under 40 characters is marked for recognition, which is left to a reader outside.
    """
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.posexplode(F.split("value", "\f")).alias("i", "text"))
    n = F.length(F.trim("text"))
    return files.select("path", (F.col("i") + 1).alias("page_number"), "text", F.length("text").alias("char_count"), (n < 40).alias("needs_ocr"))


def read_prompt(path: str) -> tuple[str, str]:
    """The system and user parts of a template with lines SYSTEM: and USER:."""
    text = Path(path).read_text(encoding="utf-8")
    m = re.search(r"(?ms)^SYSTEM:?[ \t]*\n(.*?)^USER:?[ \t]*\n(.*)\Z", text)
    if not m:
        raise ValueError("a template needs a SYSTEM and a USER part")
    return m.group(1).strip(), m.group(2).strip()


def render(template: str, **values: object) -> str:
    """Named placeholders {name} filled; all other braces stay."""
    return re.sub(r"\{(\w+)\}", lambda m: str(values[m.group(1)]) if m.group(1) in values else m.group(0), template)
