"""Every registered query that has SQL gives the rows of that SQL."""

import glob
import os

import duckdb
import pytest

from plumbline.plans.catalogue import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def plain(v):
    if v is None or v != v:
        return None
    if hasattr(v, "isoformat"):
        return str(v)[:10] if str(v).endswith("00:00:00") else str(v)
    if isinstance(v, bool):
        return v
    return round(float(v), 9) if isinstance(v, (int, float)) or hasattr(v, "as_tuple") else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, oracle, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted(tuple(str(plain(r[c])) for c in columns) for r in df.collect())
    assert rows
    if name in ORACLE_SQL:
        want = oracle.sql(ORACLE_SQL[name])
        assert sorted(want.columns) == columns
        at = [want.columns.index(c) for c in columns]
        assert rows == sorted(tuple(str(plain(r[i])) for i in at) for r in want.fetchall())
