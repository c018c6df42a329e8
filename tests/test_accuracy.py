"""Paths into saved results: what is null, what is missing."""

from pyspark.sql import functions as F

from __spark_entry__ import queries
from prospectra.operators.accuracy import matches, resolve_path


def test_null_is_not_missing(spark):
    payload = '{"a": {"b": [{"c": 1.50}, null, true, "x", [1, 2]], "n": null, "e": ""}}'
    want = {"a.b[0].c": "1.5", "a.b[1]": None, "a.b[2]": "true", "a.b[3]": "x", "a.b[4]": "[1,2]", "a.n": None, "a.e": "", "a.b[9]": "MISSING", "a.x": "MISSING", "a.n.x": "MISSING", "a.b[0]": '{"c":1.5}'}
    rows = spark.createDataFrame([(payload, p) for p in want] + [("{broken", "a"), (None, "a")], "payload string, path string")
    got = rows.select("payload", "path", resolve_path(F.col("payload"), F.col("path")).alias("v")).collect()
    assert {r["path"]: r["v"] for r in got if r["payload"] == payload} == want
    assert [r["v"] for r in got if r["payload"] != payload] == ["MISSING", "MISSING"]


def test_null_matches_null_alone(spark):
    rows = [("text", None, None, True), ("text", "x", None, False), ("text", None, "MISSING", False), ("number", "1", None, False), ("number", None, None, True)]
    got = spark.createDataFrame(rows, "kind string, e string, a string, ok boolean").select(matches(F.col("kind"), F.col("e"), F.col("a")).alias("got"), "ok").collect()
    assert all(r["got"] == r["ok"] for r in got)


def test_saved_values_are_rounded_by_their_binary_value(spark, tmp_path):
    """2440877 and half a percent are 2453081.385, as a double a little less: the saved value is 2453081.38, within the tolerance."""
    spark.createDataFrame([(19, 1)], "c_custkey long, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(19, 2440877.0)], "o_custkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    got = {r["fact_id"]: r["ok"] for r in queries()["accuracy_matches"](spark, str(tmp_path)).collect()}
    assert got == {19: True}
