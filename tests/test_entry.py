"""Every registered query against its SQL twin on the smallest test data."""

import decimal
import os
import re

import pytest

import __spark_entry__ as entry_module

duckdb = pytest.importorskip("duckdb")
DATA = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")

# The training-data queries have tests of their own beside their operators.
OTHERS = re.compile(r"op\d+_|pipeline$")
QUERIES, SQL = ({name: x for name, x in found.items() if not OTHERS.match(name)} for found in (entry_module.queries(), entry_module.oracle_sql()))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for name in TABLES:
        c.sql(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return c


def plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return value.isoformat() if hasattr(value, "isoformat") else value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([plain(r[i]) for i in order]) for r in rows)


def test_names_agree():
    assert set(SQL) <= set(QUERIES)
    assert set(QUERIES) - set(SQL) == {"file_freshness"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, DATA)
    got = df.collect()
    if name not in SQL:
        assert got
        return
    cursor = con.execute(SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, got) == rows_of(columns, cursor.fetchall())


def test_flagship(spark):
    assert entry_module.entry(spark).count() > 0
