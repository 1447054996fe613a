"""Every plan with SQL gives the oracle's rows at sf0.001."""

import duckdb
import pytest

from weftline import catalog
from weftline.plans.base import TABLES

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def _key(row):
    return tuple((v is None, v if v is not None else 0) for v in row)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_rows(spark, duck, name):
    df = catalog.QUERIES[name](spark, DIR)
    cursor = duck.execute(catalog.SQL[name])
    names = [x[0] for x in cursor.description]
    assert sorted(names) == sorted(df.columns)
    want = [tuple(r[names.index(c)] for c in df.columns) for r in cursor.fetchall()]
    assert sorted(map(tuple, df.collect()), key=_key) == sorted(want, key=_key)
