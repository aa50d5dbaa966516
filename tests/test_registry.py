"""Every registered query runs at sf0.001; those with an oracle match DuckDB row for row."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from embedframe.sources.tables import TABLES

from .conftest import SF001


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if hasattr(v, "item"):
        return _norm(v.item())
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _rows(cols, records):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in records), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return con


def test_entry(spark):
    df = E.entry(spark)
    assert df.columns[:2] == ["model", "dimension"] and df.count() == 12


def test_every_query_against_oracle(spark, duck):
    sql = E.oracle_sql()
    assert set(sql) <= set(E.queries())
    failures = []
    for key, fn in E.queries().items():
        df = fn(spark, SF001)
        rows = [tuple(r) for r in df.collect()]
        if key not in sql:
            continue
        rel = duck.sql(sql[key])
        if sorted(df.columns) != sorted(rel.columns):
            failures.append((key, "columns", df.columns, rel.columns))
        elif _rows(df.columns, rows) != _rows(rel.columns, rel.fetchall()):
            failures.append((key, "rows"))
    assert not failures, failures
