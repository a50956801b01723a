"""Every query with an oracle against DuckDB on the small tables."""

import math

import pytest

from tessera.queries import ORACLES, QUERIES

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    c = duckdb.connect()
    for t in ("customer", "events", "lineitem", "nation", "orders", "part", "region", "supplier"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def shown(v):
    return "" if v is None or isinstance(v, float) and math.isnan(v) else repr(v + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, tables, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    found = tables.sql(ORACLES[name])
    at = [found.columns.index(c) for c in cols]
    assert sorted(tuple(shown(r[c]) for c in cols) for r in df.collect()) == sorted(tuple(shown(r[i]) for i in at) for r in found.fetchall())
