"""Every registered query of the engine against its SQL, on the driver's smallest tables."""

import os

import duckdb
import pytest

from millrace.queries import ORACLES, QUERIES, TABLES

from .conftest import DATA


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    yield con
    con.close()


def normal(rows):
    def one(v):
        return round(v, 6) if isinstance(v, float) else v

    return sorted((tuple(one(v) for v in r) for r in rows), key=str)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", list(ORACLES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DATA)
    want = duck.execute(ORACLES[name])
    cols = [d[0] for d in want.description]
    assert sorted(cols) == sorted(got.columns)
    assert normal(got.select(*(f"`{c}`" for c in cols)).collect()) == normal(want.fetchall())
