"""Every query of the core runs on the smallest data and, where it has SQL, gives the same rows."""

import datetime
import decimal
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from postloom.plans import catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test data here")


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return f"{float(v):.5f}"
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return v.isoformat() if isinstance(v, datetime.datetime) else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    rows = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name not in catalog.SQL:
        return
    found = duck.sql(catalog.SQL[name])
    assert sorted(found.columns) == columns
    places = [list(found.columns).index(c) for c in columns]
    assert rows == Counter(tuple(plain(r[i]) for i in places) for r in found.fetchall())
