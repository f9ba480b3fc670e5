"""Every query with an SQL twin against it, at the smallest scale."""

import decimal
import os

import pytest

import __spark_entry__
from tracewell import queries

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def twin():
    own = duckdb.connect()
    own.sql("SET threads = 2")
    for t in TABLES:
        own.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return own


def plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float):
        return 0.0 if v == 0 else v
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_twin(spark, twin, name):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = twin.sql(queries.ORACLE_SQL[name])
    names = [x[0] for x in want.description]
    assert sorted(names) == columns
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert got == sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in want.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(queries.QUERIES.keys() - queries.ORACLE_SQL.keys()))
def test_rows(spark, name):
    df = queries.QUERIES[name](spark, SF)
    assert len(df.collect()) >= 1


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
