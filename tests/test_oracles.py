"""Every query of the library against its DuckDB oracle on the smallest data."""

import math
import os

import duckdb
import pytest

from pledgelens.plans import registry

ORACLES = registry.oracle_sql()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, list):
        return tuple(map(plain, v))
    return v if isinstance(v, (int, bool, str, type(None))) else round(float(v), 6) if hasattr(v, "as_integer_ratio") else v


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, duck, sf, name):
    df = registry.queries()[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    result = duck.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=str)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(ORACLES) - {"evaluate_classifier"}))
def test_query_has_rows(spark, sf, name):
    assert registry.queries()[name](spark, sf).count() > 0
