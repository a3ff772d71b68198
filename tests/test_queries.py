"""Each registered query outside llm against its DuckDB SQL on the smallest tables."""

import datetime
import decimal

import duckdb
import pytest

from quire import catalog

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
catalog.load()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, (float, decimal.Decimal)):
        return repr(round(float(value), 6))
    return value.replace(tzinfo=None).isoformat() if isinstance(value, datetime.datetime) else repr(value)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, db, name):
    df = catalog.QUERIES[name](spark, DIR)
    names = sorted(df.columns)
    rows = sorted(tuple(map(plain, r)) for r in df.select(*names).collect())
    if name not in catalog.ORACLES:
        assert rows
        return
    found = db.execute(catalog.ORACLES[name])
    order = [d[0] for d in found.description]
    assert sorted(order) == names
    assert rows == sorted(tuple(plain(r[order.index(n)]) for n in names) for r in found.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
