"""Every named query with SQL gives the same rows in Spark and in DuckDB."""

import datetime
import math
from pathlib import Path

import duckdb
import pytest

from freshet.plans import catalogue

KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "timestamp_ntz": "TIMESTAMP", "date": "DATE", "boolean": "BOOLEAN"}


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


def duck(folder):
    con = duckdb.connect()
    for path in Path(folder).glob("*.parquet"):
        con.sql(f"create view {path.stem} as select * from '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_same_as_sql(spark, data, name):
    df, other = catalogue.QUERIES[name](spark, data), duck(data).sql(catalogue.SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(other.columns)
    assert {c: KINDS[t] for c, t in df.dtypes} == {c: str(t) for c, t in zip(other.columns, other.types, strict=True)}
    mine = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    theirs = sorted((tuple(plain(v) for v in row) for row in other.select(*columns).fetchall()), key=repr)
    assert mine == theirs


def test_every_query_has_sql():
    assert set(catalogue.SQL) == set(catalogue.QUERIES)


def test_entry(spark):
    import __spark_entry__ as entry

    if not Path(entry.SMOKE).exists():
        pytest.skip("no test tables")
    assert entry.entry(spark).count() > 0
    assert set(catalogue.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_plans_push_down_and_broadcast(spark, data):
    from freshet.operators import predicates

    rows = catalogue.read(spark, data, "lineitem").filter(predicates.date_window(catalogue.F.col("l_shipdate"), "1996-01-01", "1996-02-01")).select("l_suppkey")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(l_shipdate" in plan and "LessThan(l_shipdate" in plan
    joined = catalogue.code_alias_semi(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in joined and "Python" not in joined
