import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from gradewright.functions.json import extract_json, first_json
from gradewright.operators.fold import ability_fold
from gradewright.operators.structure import headings, spans, structure_gate
from gradewright.sources import files, sinks
from gradewright.streaming.ability import ability_stream, accuracy_windows, study_sessions


def test_manifest_faults(tmp_path):
    good = {"sources": [{"path": "a.pdf", "page_offset": 0}], "exam": {"total": 150, "passing": 90, "sections": [{"questions": 90, "marks": 1}, {"groups": 6, "questions": 5, "marks": 1}, {"groups": 3, "questions": 5, "marks": 2}]}, "blueprint": {"overrides": {"a": 0.4, "b": 0.6}}}
    path = tmp_path / "m.json"
    path.write_text(json.dumps(good))
    assert files.load_manifest(str(path)) == good
    bad = {"sources": [{"path": "a", "page_offset": -1}], "exam": {"total": 10, "passing": 11, "sections": [{"questions": 9, "marks": 1}]}, "blueprint": {"overrides": {"a": 0.5}}}
    assert len(files.manifest_faults(bad)) == 4 and files.manifest_faults({}) == ["no sources"]
    path.write_text(json.dumps(bad))
    with pytest.raises(ValueError, match="overrides"):
        files.load_manifest(str(path))


def test_registered_files(spark, tmp_path):
    for name, text in (("a.txt", "one"), ("b.txt", "one"), ("c.txt", "two")):
        (tmp_path / name).write_text(text)
    got = {r.path[-5:]: (r.state, r.sha256) for r in files.registered_files(spark, str(tmp_path)).collect()}
    assert {k: v[0] for k, v in got.items()} == {"a.txt": "new", "b.txt": "repeated", "c.txt": "new"}
    known = spark.createDataFrame([(got["c.txt"][1],)], "sha256 string")
    assert files.registered_files(spark, str(tmp_path), known).filter("state = 'known'").count() == 1


def test_authored_files(spark, tmp_path):
    question = {"stem": "S?", "options": [{"key": k, "text": k} for k in "ABCD"], "correct_key": "A", "difficulty": 9}
    one = {"chapter_ordinal": 1, "concepts": [{"title": "T", "source_pages": ["3", "x"], "questions": [question]}], "caselets": [{"scenario": "C", "questions": [question | {"marks": 2.0}, question | {"case_position": 5}]}]}
    (tmp_path / "a.json").write_text(json.dumps(one))
    (tmp_path / "b.json").write_text("{broken")
    read = files.read_authored(spark, str(tmp_path)).cache()
    got = {(r.kind, r.owner, r.position, r.marks, r.difficulty) for r in files.authored_questions(read).collect()}
    assert got == {("concept", "T", 0, 1.0, 2), ("caselet", "C", 1, 2.0, 2), ("caselet", "C", 5, 1.0, 2)}
    assert [r.path[-6:] for r in files.rejected_files(read).collect()] == ["b.json"]
    pages = read.filter("_broken is null").select(files.whole_numbers(F.col("concepts")[0]["source_pages"])).first()[0]
    assert pages == [3]
    read.unpersist()


def test_page_text_and_prompts(spark, tmp_path):
    (tmp_path / "t.txt").write_text("x" * 50 + "\fshort\f")
    got = [(r.page_number, r.char_count, r.needs_ocr) for r in files.read_page_text(spark, str(tmp_path / "t.txt")).orderBy("page_number").collect()]
    assert got == [(1, 50, False), (2, 5, True), (3, 0, True)]
    (tmp_path / "p.txt").write_text("SYSTEM:\nBe {kind}.\nUSER:\n{\"a\": {x}}\n")
    system, user = files.read_prompt(str(tmp_path / "p.txt"))
    assert files.render(system, kind="brief") == "Be brief." and files.render(user, x=3) == '{"a": 3}'


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.refresh(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), path, "k")
    sinks.refresh(spark.createDataFrame([(2, "c"), (2, "d")], "k int, v string"), path, "k")
    assert {(r.k, r.v) for r in spark.read.parquet(path).collect()} == {(1, "a"), (2, "c"), (2, "d")}
    path = str(tmp_path / "u")
    for rows in ([(1, 1, "a"), (2, 1, "b")], [(1, 2, "c"), (2, 0, "z"), (3, 1, "d")]):
        sinks.upsert(spark.createDataFrame(rows, "k long, t long, v string"), path, "k", "t")
    assert {tuple(r) for r in spark.read.parquet(path).collect()} == {(1, 2, "c"), (2, 1, "b"), (3, 1, "d")}
    plan = spark.createDataFrame([("m", 2, None), ("m", 1, "A"), ("n", 1, "B")], "exam string, place int, chosen string")
    back = sinks.from_document(sinks.as_document(plan, "exam", ["place"]), "exam", "place:int,chosen:string")
    assert {tuple(r) for r in back.collect()} == {tuple(r) for r in plan.collect()}


def test_embedding_cache_embeds_each_text_once(spark, tmp_path):
    cache, calls = str(tmp_path / "cache"), spark.sparkContext.accumulator(0)
    plain = sinks.hashing_embedder(8)

    def embed(texts):
        calls.add(len(texts))
        return plain(texts)

    rows = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, None), (4, "c")], "id long, text string")
    first = {r.id: r.embedding for r in sinks.embedded(rows, embed, cache).collect()}
    again = {r.id: r.embedding for r in sinks.embedded(rows, embed, cache).collect()}
    assert first == again and first[3] is None and first[1] == first[2] != first[4] and calls.value == 2


def test_json_is_found(spark):
    assert first_json('{"a": 1}') == '{"a":1}' and first_json('Sure:\n```json\n[1, 2]\n```') == "[1,2]" and first_json('x {bad} then {"a": "}{"} y') == '{"a":"}{"}'
    assert first_json(None) is None and first_json("no json 12") is None and first_json('"text"') is None
    df = spark.createDataFrame([("ok {\"k\": [1]}",), (None,)], "t string")
    assert [r[0] for r in df.select(extract_json("t")).collect()] == ['{"k":[1]}', None]


def test_structure(spark):
    text = ["Chapter 1: Basics ..... 3", "Chapter 1: Basics", "1.1 First Part", "words", "1.2 Second", "UNIT 2 - More", "chapter 2: again", "2.1 Last"]
    rows = [(1, p, 1, t) for p, t in enumerate(text, 1)] + [(2, 1, 1, "nothing"), (1, 9, 1, None)]
    counts = spark.createDataFrame([(1, 10), (2, 3)], "source_id long, last_page int")
    got = spans(headings(spark.createDataFrame(rows, "source_id long, page_number int, line_no int, text string")), counts)
    assert {(r.level, r.chapter_no, r.section_no, r.title, r.page_number, r.page_end) for r in got.collect()} == {
        ("chapter", 1, None, "Basics", 2, 5), ("section", 1, 1, "First Part", 3, 4), ("section", 1, 2, "Second", 5, 5), ("chapter", 2, None, "More", 6, 10), ("section", 2, 1, "Last", 8, 10)}
    gate = {r.source_id: (r.chapters, r.overlaps, r.coverage, r.passes) for r in structure_gate(got, counts, 0.9).collect()}
    assert gate == {1: (2, 0, 0.9, True), 2: (0, 0, 0.0, False)}


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(3)
    t0 = dt.datetime(2030, 1, 1)
    rows = [(i, f"u{rng.randrange(4)}", q := rng.randrange(9), q % 3, rng.random() < 0.5, rng.choice(["sure", None]), t0 + dt.timedelta(minutes=20 * i), 0.2) for i in range(240)]
    schema = "attempt_id long, user_id string, question_id long, concept_id long, correct boolean, confidence string, created_at timestamp, q_start double"
    src = str(tmp_path / "in")
    for k in range(3):
        spark.createDataFrame(rows[80 * k: 80 * k + 80], schema).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    got: dict = {}

    def keep(df, _):
        for r in df.collect():
            got[r.concept_id, r.kind, r.user_id, r.question_id] = (round(r.rating, 9), r.n)

    query = ability_stream(stream).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    want = {(r.concept_id, r.kind, r.user_id, r.question_id): (round(r.rating, 9), r.n) for r in ability_fold(spark.createDataFrame(rows, schema)).collect()}
    assert got == want
    table = spark.createDataFrame(rows, schema)
    assert accuracy_windows(table).agg(F.sum("n"), F.sum("right")).first() == (240, sum(r[4] for r in rows))
    sessions = study_sessions(table).collect()
    assert sum(r.n for r in sessions) == 240 and all(r.finish > r.start for r in sessions)
