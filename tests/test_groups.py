"""Groups of one title with dismissals."""

import itertools
import random

from annalist.operators import relational as R


def test_camps_are_dismissals_without_their_pairs(spark):
    rows = [("x", 5), ("x", 1), ("y", 5), ("y", 10), ("y", 1), ("z", 1), ("z", 2), ("w", 5), ("w", 1), ("w", 2), ("v", 3), (None, 7), (None, 8), ("u", 5), ("u", None)]
    df = spark.createDataFrame(rows, "t string, k long")
    pairs = [(a, b) for (s, a), (u, b) in itertools.product(rows, repeat=2) if s == u and a and b and a % 5 == 0 and b % 5]
    plain = R.exact_groups(df, ["t"], "k", spark.createDataFrame(pairs, "a long, b long"))
    got = R.exact_groups(df, ["t"], "k", camp=df.k % 5 == 0)
    assert sorted(map(str, got.collect())) == sorted(map(str, plain.collect())) != []


def test_contained_in_masks(spark):
    """Groups of up to more members than a mask has bits, against every pair."""
    r = random.Random(2)
    sets = {g: set(r.sample(range(30), r.randint(1, 9))) for g in range(60)} | {100: set(range(400)), 101: set(range(1, 300)), 102: {7}}
    df = spark.createDataFrame([(g, m) for g, v in sets.items() for m in v] * 2 + [(None, 1), (5, None)], "g long, m long")
    found = R.contained_in(df, "g", "m")
    assert sorted(map(tuple, found.collect())) == sorted((a, b) for a, b in itertools.permutations(sets, 2) if sets[a] <= sets[b])
    assert "bit_or" in found._jdf.queryExecution().toString()  # groups that lack a member are told apart before they are shuffled
