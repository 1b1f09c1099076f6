"""Every registered query of the engine over the smallest tables, against its DuckDB twin where it has one."""

import datetime
import decimal
import math

import pytest

import __spark_entry__  # noqa: F401
from tidemark.plans import registry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return con


def plain(value):
    """A value as both engines give it: numbers to nine digits, times without a zone."""
    if isinstance(value, (float, decimal.Decimal)):
        return "nan" if math.isnan(value) else float(f"{float(value):.9g}")
    return value.replace(tzinfo=None) if isinstance(value, datetime.datetime) else value


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    mine = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    assert mine
    if name in registry.ORACLES:
        found = duck.execute(registry.ORACLES[name])
        names = [c[0] for c in found.description]
        assert sorted(names) == columns
        assert mine == sorted(repr(tuple(plain(r[names.index(c)]) for c in columns)) for r in found.fetchall())
