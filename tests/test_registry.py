"""Every registered query of the archive agrees with its SQL on the smallest tables."""

import os

import duckdb
import pytest

from lumenarc.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows(spark, duck, name):
    mine = registry.queries()[name](spark, SF)
    names = sorted(mine.columns)
    got = sorted((tuple(r[c] for c in names) for r in mine.collect()), key=repr)
    rel = duck.sql(registry.oracle_sql()[name])
    assert sorted(rel.columns) == names
    want = sorted(rel.select(*[duckdb.ColumnExpression(c) for c in names]).fetchall(), key=repr)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert all(x == y or isinstance(x, float) and abs(x - y) < 1e-5 for x, y in zip(a, b, strict=True)), (a, b)
