"""Every registered query of the document engine against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from quire import catalog

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for name in os.listdir(DATA):
        c.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{DATA}/{name}'")
    return c


def rows(df, columns):
    def plain(v):
        if v is None or v != v:
            return ""
        v = v.item() if hasattr(v, "item") else v
        return repr(round(v, 9)) if isinstance(v, float) else str(v)

    return sorted(tuple(plain(v) for v in r) for r in df[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_rows_as_sql(spark, con, name):
    got = catalog.QUERIES[name](spark, DATA).toPandas()
    want = con.sql(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got, sorted(got.columns)) == rows(want, sorted(got.columns))


def test_streamed_passages_are_the_batch_ones(spark):
    streamed = catalog.QUERIES["stream_passages"](spark, DATA).toPandas()
    batch = catalog.QUERIES["passages"](spark, DATA).toPandas()
    columns = ["doc_id", "number", "char_start", "char_end"]
    assert rows(streamed, columns) == rows(batch, columns)
