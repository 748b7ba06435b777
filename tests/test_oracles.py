"""Every query with SQL returns the same rows as that SQL."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rounded(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(rounded(x) for x in v)
    return v


def canonical(rows):
    return sorted(repr(tuple(rounded(x) for x in r)) for r in rows)


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for x in TABLES:
        c.execute(f"create view {x} as select * from '{SF_DIR}/{x}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_rows(spark, duck, name):
    df = entry.queries()[name](spark, SF_DIR)
    columns = sorted(df.columns)
    mine = [tuple(r) for r in df.select(*[f"`{c}`" for c in columns]).collect()]
    result = duck.execute(entry.oracle_sql()[name])
    names = [x[0] for x in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    theirs = [tuple(r[i] for i in order) for r in result.fetchall()]
    assert len(mine) == len(theirs)
    a, b = canonical(mine), canonical(theirs)
    different = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    assert not different, different[:3]
