"""Inputs on which an operator once did less than its whole job."""

from itertools import permutations

from annalist.sources import tables


def test_cache_lookup_tie(spark):
    """Answers of one time: the same one counts whatever their order, and any before none."""
    now = "2001-07-30"
    for p in permutations(["a", "b", None]):
        cache = spark.createDataFrame([(1, x, now) for x in p] + [(1, "z", "2001-07-01")], "k long, payload string, fetched_at string").coalesce(1)
        got = tables.cache_lookup(spark.createDataFrame([(1,), (2,)], "k long"), cache, "k", "2001-08-01", 180, 30)
        assert {(r.k, r.payload, r.state) for r in got.collect()} == {(1, "b", "found"), (2, None, "missing")}
