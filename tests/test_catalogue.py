"""Every query runs, and those that SQL can say agree with DuckDB, on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from presswork import catalogue

from .conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canon(v):
    if isinstance(v, (list, tuple)):
        return tuple(canon(x) for x in v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v if v is None or isinstance(v, (bool, int)) else round(float(v), 6) if type(v).__name__ == "Decimal" else str(v)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, name):
    df = catalogue.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(canon(v) for v in r) for r in df.select(columns).collect()), key=repr)
    if sql := catalogue.oracle_sql().get(name):
        con = duckdb.connect()
        for t in TABLES:
            con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
        want = con.sql(sql)
        places = [want.columns.index(c) for c in columns]
        assert sorted(want.columns) == columns
        assert got == sorted((tuple(canon(r[i]) for i in places) for r in want.fetchall()), key=repr)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
