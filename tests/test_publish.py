"""Versions, their manifest, and what a failed write leaves."""

import pytest
from pyspark.sql import functions as F

from annalist.operators import relational as R
from annalist.sources import tables


def test_publish_version(spark, tmp_path):
    folder = str(tmp_path / "site")
    with pytest.raises(ValueError):
        tables.published(spark, folder)
    a = spark.createDataFrame([(1, "x", "secret"), (2, None, "secret")], "id long, name string, key string")
    allow = {"a": ["id", "name", "gone"], "b": ["n"], "missing": ["x"]}
    first = tables.publish_version({"a": a, "b": spark.range(5).toDF("n")}, allow, folder)
    assert {(r.version, r.table, r.rows) for r in first.collect()} == {(1, "a", 2), (1, "b", 5)} and all(r.bytes > 0 for r in first.collect())
    broken = a.withColumn("name", F.raise_error(F.lit("half way")).cast("string"))
    with pytest.raises(Exception, match="half way"):
        tables.publish_version({"b": spark.range(9).toDF("n"), "a": broken}, {"b": ["n"], "a": ["id", "name"]}, folder)
    manifest, now = tables.published(spark, folder)
    assert manifest.select("version").distinct().collect()[0][0] == 1 and now["b"].count() == 5 and now["a"].columns == ["id", "name"]
    tables.publish_version({"a": a.limit(0), "b": spark.range(7).toDF("n")}, allow, folder)
    manifest, now = tables.published(spark, folder)
    assert {(r.version, r.table, r.rows) for r in manifest.collect()} == {(2, "a", 0), (2, "b", 7)} and now["a"].schema == a.select("id", "name").schema
    assert tables.published(spark, folder, 1)[1]["b"].count() == 5


def test_contained_in_hot(spark):
    """A large group, many groups of one hot member, and equal groups."""
    rows = [(0, i) for i in range(3000)] + [(g, 0) for g in range(1, 40)] + [(100, 1), (100, 2), (101, 2), (101, 1), (102, 1), (102, 5000), (None, 1), (103, None)]
    sets = {}
    for g, m in rows:
        if g is not None and m is not None:
            sets.setdefault(g, set()).add(m)
    want = {(a, b) for a in sets for b in sets if a != b and sets[a] <= sets[b]}
    got = R.contained_in(spark.createDataFrame(rows, "g long, m long"), "g", "m").collect()
    assert {(r.small, r.big) for r in got} == want and len(got) == len(want)
