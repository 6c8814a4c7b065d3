"""Every registered query against DuckDB on the same tables, and the shape of its plan."""

import contextlib
import io

import pytest

import __spark_entry__ as entry
from compare import compare, duck
from gleanframe.queries import oracle_sql, queries

SF_DIR = "/root/testdata/sf0.001"
NAMES = list(queries())


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, con, name):
    ok, note = compare(spark, con, SF_DIR, name, entry.queries()[name], entry.oracle_sql()[name])
    assert ok, note


def test_every_query_has_sql():
    assert set(oracle_sql()) == set(NAMES)


def test_entry(spark):
    assert entry.entry(spark).columns == ["word", "count"]


# Queries whose call only builds a plan; the others run passes or write tables first.
LAZY = [
    "keywords", "keywords_per_document", "bigrams", "bigrams_per_document", "numbers", "entities", "key_values", "topics",
    "sentiment", "page_sentiment", "text_profile", "chunk_paragraphs", "chunk_sentences", "missing", "categorical_stats",
    "count_duplicates", "quality_score", "value_counts", "group_sum_topk", "parse_json_records", "fresh_rows",
    "deduplicate", "deduplicate_by_key", "find_duplicates", "fingerprint", "merge_and_deduplicate",
    "detect_changes", "field_changes", "snapshot_diffs", "snapshot_field_changes", "check_alerts", "session_summary",
    "pie_with_other", "waterfall", "funnel", "treemap", "pages_to_text", "classify_pages",
]


@pytest.mark.parametrize("name", LAZY)
def test_plan_has_no_cross_join(spark, name):
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        entry.queries()[name](spark, SF_DIR).explain("formatted")
    assert "CartesianProduct" not in text.getvalue()
    assert "BroadcastNestedLoopJoin" not in text.getvalue()


def test_scan_reads_only_what_is_used(spark):
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        entry.queries()["group_sum_topk"](spark, SF_DIR).explain("formatted")
    assert "ReadSchema: struct<l_suppkey:bigint,l_quantity:double>" in text.getvalue()


def test_stale_rows_are_filtered_in_the_scan(spark):
    from datetime import datetime

    from gleanframe.session import load
    from gleanframe.sources.crawl_log import fresh_rows

    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        fresh_rows(load(spark, SF_DIR, "events"), datetime(2024, 1, 29), key="user_id").explain("formatted")
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in text.getvalue()
