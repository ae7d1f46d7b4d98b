"""Every registered research-data query against its oracle on the smallest tables."""

import glob
import os

import duckdb
import pytest

from sievework.plans import catalogue

DATA = os.environ.get("SIEVEWORK_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def plain(v):
    if isinstance(v, float):
        return f"{v:.6f}"
    return None if v is None else str(v)


def table(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(columns), sorted([tuple(plain(r[i]) for i in order) for r in rows], key=str)


def test_each_query_has_an_oracle():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLES)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_matches_oracle(spark, db, name):
    df = catalogue.QUERIES[name](spark, DATA)
    got = table(df.columns, [tuple(r) for r in df.collect()])
    cur = db.execute(catalogue.ORACLES[name])
    assert got == table([c[0] for c in cur.description], cur.fetchall())
