"""Registered queries over texts give whole texts."""

import pytest

import __spark_entry__ as entry

LONG = {k: f"{k} " + "word " * 300 + f"end of {k}" for k in ("q1", "a1", "a2", "q2", "a3", "The note")}
TURNS = [(1, 1, "user", LONG["q1"]), (1, 2, "assistant", LONG["a1"]), (1, 3, "system", LONG["The note"]), (1, 4, "assistant", LONG["a2"]), (1, 5, "user", LONG["q2"]), (1, 6, "assistant", LONG["a3"]), (2, 1, "assistant", LONG["a1"]), (2, 2, "user", ""), (3, 1, "user", None)]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("whole")
    spark.createDataFrame(TURNS, "conv_id long, turn int, role string, text string").write.parquet(f"{at}/conversations.parquet")
    pages = [(1, "<html><title>" + "A long title, " * 20 + "its end</title>"), (2, "<title>short</title>"), (3, "<title></title>"), (4, None)]
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(f"{at}/pages.parquet")
    return str(at)


def test_stitched_transactions(spark, tables):
    got = {(r.conv_id, r.row): (r.transaction_number, r.ask, r.answer) for r in entry.queries()["stitched_transactions"](spark, tables).collect()}
    first = (1, LONG["q1"], LONG["a1"] + " / " + LONG["a2"])
    assert got == {(1, 2): first, (1, 4): first, (1, 6): (2, LONG["q2"], LONG["a3"])}


def test_bookend_flags(spark, tables):
    got = {(r.conv_id, r.row): (r.transaction_start, r.transaction_end) for r in entry.queries()["bookend_flags"](spark, tables).collect()}
    assert got == {(c, t): (role == "user" and bool(x), role == "assistant" and bool(x)) for c, t, role, x in TURNS if role != "system"}


def test_region_search(spark, tables):
    got = {r.doc_id: r.found for r in entry.queries()["region_search"](spark, tables).collect()}
    assert got == {1: "<title>" + "A long title, " * 20 + "its end", 2: "<title>short", 3: None, 4: None}
