"""Every registered query against its SQL in DuckDB; queries without SQL must give rows."""

import math
import os
from pathlib import Path

import duckdb
import pytest

from cytoquill.plans.registry import ORACLE, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not Path(SF).is_dir(), reason="no test data")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF)
    rows, cols = [tuple(r) for r in df.collect()], df.columns
    assert len(set(cols)) == len(cols)
    if name not in ORACLE:
        assert rows
        return
    got = db.execute(ORACLE[name])
    names = [c[0] for c in got.description]
    assert sorted(names) == sorted(cols)
    order = lambda have: [have.index(c) for c in sorted(have)]
    mine = sorted(tuple(plain(r[i]) for i in order(cols)) for r in rows)
    theirs = sorted(tuple(plain(r[i]) for i in order(names)) for r in got.fetchall())
    assert mine == theirs
