from __future__ import annotations

import glob
import math
import os

import pytest

import __spark_entry__ as entry


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_has_rows_of_a_schema():
    q, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(q)
    assert {"grep_by_source", "p5_found"} <= set(q)


def normal(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(normal(x) for x in v)
    if hasattr(v, "tzinfo") and v.tzinfo:
        return v.replace(tzinfo=None)
    return v


CORE = [n for n in entry.core.oracle_sql() if not n.startswith("stream")]


@pytest.mark.parametrize("name", CORE)
def test_same_as_sql(spark, data, name):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{data}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df = entry.queries()[name](spark, data)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(normal(r[c]) for c in cols)) for r in df.collect())
    res = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == sorted(repr(tuple(normal(row[i]) for i in at)) for row in res.fetchall())


def test_queries_are_listed_without_a_session():
    """The lists are made before there is a session: no column is built until a query is called."""
    import subprocess
    import sys
    from pathlib import Path

    code = "import __spark_entry__ as e; assert len(e.queries()) >= len(e.oracle_sql()) > 100"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).resolve().parent.parent)
