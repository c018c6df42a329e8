"""Queries read and work out their inputs once."""

from __future__ import annotations

import re

from prospectra.operators import report, statements
from prospectra.plans.catalogue import catalogue

SF = "/root/testdata/sf0.001"


def reads(df, column):
    """How often a plan reads the table with that column."""
    return len(re.findall(rf"Relation \[[^\]]*\b{column}#", df._jdf.queryExecution().optimizedPlan().toString()))


def test_tables_are_read_once(spark):
    queries = catalogue().queries
    assert reads(queries["assemble_items"](spark, SF), "l_suppkey") == 2         # the figures, and the last year
    view = queries["analysis_view"](spark, SF)
    assert reads(view, "event_id") == 1 and reads(view, "c_custkey") <= 1 and reads(view, "s_suppkey") <= 1


def test_scores_and_facts_share_what_they_use(spark):
    queries = catalogue().queries
    for name in ("total_and_rating", "cite_points", "collect_facts"):
        df = queries[name](spark, SF)
        assert reads(df, "event_id") <= 1 and reads(df, "l_shipdate") <= 1 and reads(df, "lang") <= 1, name


def test_borrowings_add_up_and_other_items_count_once(spark):
    row = lambda label, entry, period, value: (1, 60, 1, entry, "balance_sheet", "million", label, "", period, value)        # noqa: E731
    values = spark.createDataFrame(
        [row("Non-current borrowings", 0, "FY2024", 1.5), row("Non-current borrowings", 0, "FY2023", None), row("Borrowings", 4, "FY2024", 2.25), row("Borrowings", 4, "FY2022", 7.0),
         row("Total assets", 5, "FY2024", 9.0), row("Total assets", 6, "FY2024", 8.0)],
        "doc_id long, page int, table_no int, entry_no int, statement string, unit string, label string, parent string, period string, value double")
    assert sorted(map(tuple, statements.assemble_items(values).select("item", "period", "value").collect()), key=str) == [
        ("borrowings", "FY2022", 7.0), ("borrowings", "FY2023", None), ("borrowings", "FY2024", 3.75), ("total_assets", "FY2024", 9.0)]


def test_latest_status_of_each_agent(spark):
    documents = spark.createDataFrame([(1, 0, [(2, "B", None, 5, 9), (1, "A", "a", 1, 4)]), (2, 3, [])],
                                      "doc_id long, page_offset int, sections array<struct<pos int, title string, key string, start_page int, end_page int>>")
    results = spark.createDataFrame([(1, "risk", 5, "done"), (1, "risk", 9, "failed"), (1, "legal", 7, "done")], "doc_id long, agent string, result_id long, status string")
    rows = {r["doc_id"]: r for r in report.analysis_view(documents, results, ["risk", "legal", "offer"]).collect()}
    assert [s["title"] for s in rows[1]["sections"]] == ["A", "B"] and rows[2]["sections"] is None
    assert (rows[1]["risk"], rows[1]["legal"], rows[1]["offer"], rows[2]["risk"]) == ("failed", "done", None, None)
