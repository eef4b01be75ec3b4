"""Every registered query against its SQL, at the smallest scale."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from chronoweave.plans import registry
from chronoweave.plans.views import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        files = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{files}')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0 if v else 0.0)
    return repr(float(v)) if hasattr(v, "is_finite") else repr(v)


def table(rows, names):
    at = [names.index(c) for c in sorted(names)]
    return sorted(tuple(plain(r[i]) for i in at) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    rows = df.collect()
    if name in registry.ORACLE_SQL:
        want = duck.execute(registry.ORACLE_SQL[name])
        names = [x[0] for x in want.description]
        assert sorted(names) == sorted(df.columns)
        assert table(rows, df.columns) == table(want.fetchall(), names)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
