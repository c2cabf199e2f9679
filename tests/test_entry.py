"""The driver contract, and every SQL-checkable query against DuckDB on small tables."""

import math
import os
import threading

import duckdb
import pytest

import __spark_entry__ as entry
from terrapanel.plans import registry

SF = "/root/testdata/sf0.01"
#: Queries that have no rows on the smallest tables.
EMPTY: set[str] = set()


def normal(rows):
    def cell(v):
        if isinstance(v, float) or hasattr(v, "as_tuple"):
            return "nan" if math.isnan(v) else f"{float(v) + 0.0:.4f}".replace("-0.0000", "0.0000")
        if isinstance(v, (list, tuple)):
            return str([cell(x) for x in v])
        return str(v)

    return sorted(tuple(cell(v) for v in r) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def test_names_agree():
    queries, oracle = entry.queries(), entry.oracle_sql()
    assert set(oracle) <= set(queries) and len(queries) > 150


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql_finishes(spark, name):
    """Every query that SQL can't check runs on the smallest tables, with rows, within a time limit."""
    got = []
    job = threading.Thread(target=lambda: got.append(registry.queries()[name](spark, "/root/testdata/sf0.001").collect()), daemon=True)
    job.start()
    job.join(120)
    assert got, f"{name} failed or wasn't done after two minutes"
    assert got[0] or name in EMPTY


def test_entry(spark):
    assert entry.entry(spark).columns == ["treated", "event_time", "label_available", "effect"]


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    result = duck.execute(registry.oracle_sql()[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert normal(df.select(*columns).collect()) == normal([[r[i] for i in order] for r in result.fetchall()])
