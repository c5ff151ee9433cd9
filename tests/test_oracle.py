"""Every registered query with an oracle equals its DuckDB text (sf0.001):
same column names and types, same rows in any order, exact values."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as E
from riskweave.plans.registry import ORACLE

TABLES = ["orders", "lineitem"]
SPARK_TO_DUCK = {"LongType()": "BIGINT", "IntegerType()": "INTEGER", "DoubleType()": "DOUBLE",
                 "StringType()": "VARCHAR"}
# the optional subpackage has its own tests
NAMES = sorted(ORACLE)


def _duck_type(dt) -> str:
    from pyspark.sql.types import ArrayType
    if isinstance(dt, ArrayType):
        return _duck_type(dt.elementType) + "[]"
    return SPARK_TO_DUCK.get(repr(dt), repr(dt))


def _norm(v):
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else repr(v)
    return repr(v)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(sf, t)}.parquet')")
    return con


def test_every_query_has_a_callable():
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, sf, duck, name):
    df = E.queries()[name](spark, sf)
    rows = df.collect()
    rel = duck.sql(E.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    stypes = {f.name: _duck_type(f.dataType) for f in df.schema}
    dtypes = dict(zip(rel.columns, (str(t) for t in rel.types)))
    assert stypes == dtypes
    cols = sorted(df.columns)
    drows = rel.fetchall()
    a = sorted(tuple(_norm(r[c]) for c in cols) for r in rows)
    b = sorted(tuple(_norm(r[rel.columns.index(c)]) for c in cols) for r in drows)
    assert a == b


def test_entry_smoke(spark):
    out = E.entry(spark)
    assert out.columns[:2] == ["dimension", "segment"]
    assert out.count() == 14
