"""Every query against its SQL, on the given tables."""

import os

import duckdb
import pytest

import annalist.plans.basics
import annalist.plans.catalogue
import annalist.plans.changes
import annalist.plans.curation
import annalist.plans.entities
import annalist.plans.pages
import annalist.plans.resolving
import annalist.plans.titles  # noqa: F401 (all of them add their queries)
from annalist.plans.registry import ORACLE_SQL, QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, duck, name):
    got = QUERIES[name](spark, DATA)
    rel = duck.sql(ORACLE_SQL[name])
    cols = sorted(got.columns)
    assert cols == sorted(rel.columns)
    rows = lambda rs, names: sorted((tuple(dict(zip(names, r, strict=True))[c] for c in cols) for r in rs), key=repr)
    a, b = rows(map(tuple, got.collect()), got.columns), rows(rel.fetchall(), rel.columns)
    assert a == b
