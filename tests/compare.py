"""Runs a registered query on Spark and its check on DuckDB and compares the rows."""

from __future__ import annotations

import math
import time

import duckdb

from prospectra.plans.inputs import TABLES


def normal(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return float(f"{value:.9g}") + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(normal(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, normal(v)) for k, v in value.items()))
    return value


KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN",
         "timestamp_ntz": "TIMESTAMP", "array<string>": "VARCHAR[]", "array<bigint>": "BIGINT[]",
         "array<int>": "INTEGER[]", "array<double>": "DOUBLE[]"}


def connect(sf_dir):
    con = duckdb.connect()
    con.sql("SET threads=4")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def run_spark(spark, fn, sf_dir):
    start = time.time()
    df = fn(spark, sf_dir)
    columns = sorted(df.columns)
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    rows = [tuple(normal(r[c]) for c in columns) for r in df.collect()]
    return columns, types, rows, time.time() - start


def run_check(con, sql):
    start = time.time()
    rel = con.sql(sql)
    names, kinds = rel.columns, dict(zip(rel.columns, [str(t) for t in rel.types]))
    order = [names.index(c) for c in sorted(names)]
    rows = [tuple(normal(r[i]) for i in order) for r in rel.fetchall()]
    return sorted(names), kinds, rows, time.time() - start


def difference(spark, con, fn, sql, sf_dir):
    """None when equal, else a short description; also returns the two times and the row count."""
    columns, types, rows, t_spark = run_spark(spark, fn, sf_dir)
    names, kinds, expected, t_check = run_check(con, sql)
    problem = None
    if columns != names:
        problem = f"columns {columns} != {names}"
    else:
        wrong = {c: (types[c], kinds[c]) for c in columns if KINDS.get(types[c], types[c]) != kinds[c]}
        if wrong:
            problem = f"types {wrong}"
        a, b = sorted(rows, key=repr), sorted(expected, key=repr)
        if a != b:
            left = [r for r in a if r not in set(b)][:3] if len(a) < 200000 else []
            right = [r for r in b if r not in set(a)][:3] if len(b) < 200000 else []
            problem = f"{problem or ''} rows {len(a)} vs {len(b)}\n   spark only {str(left)[:900]}\n   check only {str(right)[:900]}\n   cols {columns}"
    return problem, len(rows), t_spark, t_check


if __name__ == "__main__":
    import sys

    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as entry
    from tests.conftest import session

    sf = sys.argv[1]
    wanted = sys.argv[2:]
    spark, con = session(), connect(sf)
    queries, checks = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if wanted and not any(w in name for w in wanted):
            continue
        try:
            if name not in checks:
                _, _, rows, t = run_spark(spark, fn, sf)
                print(f"rows-only {name}: {len(rows)} rows, {t:.1f}s", flush=True)
                continue
            problem, n, a, b = difference(spark, con, fn, checks[name], sf)
            print(f"{'ok  ' if problem is None else 'FAIL'} {name}: {n} rows, spark {a:.1f}s check {b:.1f}s {problem or ''}", flush=True)
            bad += problem is not None
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"ERR  {name}: {str(e)[:1500]}", flush=True)
    print("bad", bad)
