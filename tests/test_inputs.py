"""Derived inputs."""

from __future__ import annotations

import pytest

from prospectra.plans import inputs


@pytest.mark.parametrize("prices, rev", [([0.1] * 50, 0.01), ([1e35, 1.0], 1e32), ([None, 5.0], 0.01)], ids=["order", "too large for decimals", "null"])
def test_revenue_does_not_depend_on_the_order_of_addition(spark, tmp_path, prices, rev):
    fields = [f.split() for f in inputs.SCHEMAS["lineitem"].split(", ")]
    rows = spark.createDataFrame([(p, i) for i, p in enumerate(prices)], "l_extendedprice double, l_orderkey long")
    given = {"l_extendedprice": "l_extendedprice", "l_orderkey": "l_orderkey", "l_suppkey": "1", "l_discount": "0.0", "l_shipdate": "timestamp_ntz '2001-05-01'"}
    rows.selectExpr(*(f"CAST({given.get(n, 'null')} AS {t}) AS {n}" for n, t in fields)).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    inputs.derived.cache_clear(), inputs.table.cache_clear()
    assert [(r["doc_id"], r["y"], r["rev"]) for r in inputs.derived(spark, str(tmp_path), "fin_rev").collect()] == [(1, 2001, rev)]
