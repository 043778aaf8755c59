"""The plans read only the columns they need, push filters to the scan, and hold no product of tables."""

import re

import pytest

from gradewright.plans import catalogue

_SF = "/root/testdata/sf0.001"


def _plan(spark, name):
    return catalogue.QUERIES[name](spark, _SF)._jdf.queryExecution().toString()


@pytest.mark.parametrize("name,table,columns", [
    ("token_counts", "chunk_id", {"chunk_id", "content", "token_count"}),
    ("last_seen", "attempt_id", {"attempt_id", "user_id", "question_id", "created_at"}),
    ("pull_histogram", "attempt_id", {"attempt_id", "question_id", "chosen_key"}),
    ("sentence_counts", "doc_id", {"doc_id", "text"}),
    ("parse_coverage", "page_id", {"page_id", "source_id", "text", "ocr_used"}),
    ("usual_confidence", "attempt_id", {"attempt_id", "user_id", "confidence"}),
])
def test_scans_are_pruned(spark, name, table, columns):
    schemas = [set(re.findall(r"(\w+):", s)) for s in re.findall(r"ReadSchema: struct<([^>]*)>", _plan(spark, name))]
    assert any(s == columns for s in schemas), schemas


@pytest.mark.parametrize("name,pushed", [("dehyphenated", None), ("sentence_counts", "IsNotNull(text)"), ("content_duplicates", "IsNotNull(text)")])
def test_filters_reach_the_scan(spark, name, pushed):
    assert pushed is None or pushed in _plan(spark, name)


def test_no_products(spark):
    for name in ("mastery_heatmap", "chapter_pages", "theta_as_of", "desirable_pick", "bank_contamination", "kept_prerequisites", "scanned_only_chunks", "untested_estimates"):
        plan = _plan(spark, name)
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_expressions_stay_in_the_jvm(spark):
    for name in ("replay_stability", "misconception_flags", "review_due", "token_counts", "discrimination", "priority_rank", "session_scores", "page_chrome", "bank_contamination", "bootstrap_band", "review_order"):
        assert not re.search(r"Python|Pandas|InArrow", _plan(spark, name)), name
