"""Ratios and fuzzy matching against plain versions."""

import difflib
import itertools
import random

from annalist.functions import ratios
from annalist.operators import matching as M


def indel(a, b):
    """By the table of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return 200.0 * row[-1] / (len(a) + len(b)) if a or b else 100.0


def words(seed, n=60):
    r = random.Random(seed)
    base = ["".join(r.choice("abcdef ") for _ in range(r.randint(4, 16))).strip() or "x" for _ in range(n // 3)]
    out = list(base)
    for b in base * 2:
        c = list(b)
        for _ in range(r.randint(0, 2)):
            c.insert(r.randint(0, len(c)), r.choice("abé"))
        out.append("".join(c))
    return out


def test_ratios():
    for a, b in itertools.product(["", "a", "kitten", "sitting", "zürich é", "aa bb", "bb aa cc"], repeat=2):
        assert abs(ratios.indel(a, b) - indel(a, b)) < 1e-9
        assert abs(ratios.sequence(a, b) - 100 * difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()) < 1e-9
    assert ratios.token_set("the red ring", "ring red") == 100.0 and ratios.token_sort("bb aa", "aa bb") == 100.0 and ratios.token_set("", "a") == 0.0


def test_pair_scores(spark):
    df = spark.createDataFrame([("abc", "abd"), (None, "x"), ("", "")], "x string, y string")
    got = {(r.x, r.y): (r.indel, r.token_set) for r in M.pair_scores(df, "x", "y").collect()}
    assert got[None, "x"] == (None, None) and abs(got["abc", "abd"][0] - indel("abc", "abd")) < 1e-9


def test_fuzzy_pairs_and_nearest(spark):
    texts = words(1)
    df = spark.createDataFrame([(i, t, i % 2) for i, t in enumerate(texts)], "key long, t string, b long")
    for block in (None, "b"):
        first = {}
        for i, t in enumerate(texts):
            first.setdefault((i % 2 if block else 0, t), []).append(i)
        want = {(v[0], v[1]) for v in first.values() if len(v) > 1}
        for (bx, x), (by, y) in itertools.combinations(first, 2):
            if bx == by and indel(x, y) >= 84:
                want.add(tuple(sorted((first[bx, x][0], first[by, y][0]))))
        assert {(r.a, r.b) for r in M.fuzzy_pairs(df, "key", "t", 84, block).collect()} == want
    gone = spark.createDataFrame([tuple(reversed(p)) for p in list(want)[:3]], "a long, b long")
    assert len(M.fuzzy_pairs(df, "key", "t", 84, "b", gone).collect()) == len(want) - 3
    new, known = df.where("key < 30"), df.where("key >= 30")
    want = {}
    for i in range(30):
        best = {}
        for j in range(30, len(texts)):
            if texts[j] not in best and indel(texts[i], texts[j]) >= 84:
                best[texts[j]] = (-indel(texts[i], texts[j]), j)
        for nth, (r, j) in enumerate(sorted(best.values())[:2], 1):
            want[i, nth] = (j, round(-r, 6))
    assert {(r.key, r.nth): (r.match, round(r.ratio, 6)) for r in M.nearest(new, known, "key", "t", 84, 2).collect()} == want


def test_scores(spark):
    c = spark.createDataFrame([(1, 1, "abba", "abba", 100, 5, 2), (1, 2, "abba", "abbo", 90, None, None), (2, 3, "x y", "x y", 96, None, None), (3, 4, "q", "q", 80, 4, 0), (3, 5, "q", "q", 80, None, None)], "entity long, candidate long, local string, name string, search long, titles long, matched long")
    got = {r.candidate: (r.confidence, r.tier) for r in M.score_actors(c, "entity").collect()}
    assert got == {1: (79.0, "high"), 2: (81.0, "medium"), 3: (98.4, "high"), 4: (61.0, "low"), 5: (92.0, "low")}
    p = spark.createDataFrame([(1, 1, "a", "a", 10, 6, False), (1, 2, "a", "a", 10, 3, False), (1, 3, "abcdef", "abcdeg", 10, 1, False), (2, 4, "a", "a", 0, None, True), (3, 5, "z", "z", 4, 4, False), (3, 6, "z", "z", 4, 2, False)], "entity long, candidate long, local string, title string, played long, matched long, conflict boolean")
    got = {r.candidate: (r.confidence, r.tier) for r in M.score_parents(p, "entity").collect()}
    assert got == {1: (84.0, "high"), 2: (72.0, "medium"), 4: (70.0, "low"), 5: (100.0, "medium"), 6: (80.0, "medium")}


def test_overlap_actors_search(spark):
    actors = spark.createDataFrame([(1, "the red band", "x"), (2, "red band the", None), (3, "the red bant", "y"), (4, "other one", None)], "key long, name string, ext string")
    found = {(r.a, r.b): (round(r.ratio), r.same_name) for r in M.actor_pairs(actors, "key", "name", "ext", 90).collect()}
    assert found == {(1, 2): (100, True), (2, 3): (92, False)}  # 1 and 3 have ids that differ
    titles = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (2, "b"), (3, None)], "key long, title string")
    gone = spark.createDataFrame([(3, 2)], "a long, b long")
    assert [(r.a, r.b, r.shared) for r in M.actor_pairs(actors, "key", "name", "ext", 90, dismissed=gone, titles=titles).collect()] == [(1, 2, 1)]
    versions = spark.createDataFrame([(1, 1, "ride the lightning", None), (2, 1, "the lightning ride live", None), (3, 1, "ride the lightning", None), (4, 1, "lightning the ride", "2"), (5, 2, "ride the lightning", None), (6, 1, "one", None)], "k long, o long, t string, s string")
    assert {(r.a, r.b) for r in M.similar_versions(versions, "k", "o", "t", "s").collect()} == {(1, 2), (2, 3)}
    items = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "b"), (2, "c"), (3, "z")], "p long, i string")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (1, 9)], "a long, b long")
    assert {(r.a, r.b): r.overlap for r in M.list_overlap(items, "p", "i", pairs).collect()} == {(1, 2): 100.0, (1, 3): 0.0, (1, 9): None}
    table = spark.createDataFrame([(1, "red ring", 5), (2, "ring", 1), (3, "red rings", 9), (4, "ring road", 7), (5, "big red ring", 3)], "k long, t string, w long")
    q = spark.createDataFrame([("ring",), ("red ring",)], "query string")
    got = {(r.query, r.nth): (r.k, r.band) for r in M.fuzzy_search(q, table, "k", "t", "w").collect()}
    assert [got["ring", i][0] for i in (1, 2, 3, 4)] == [2, 4, 1, 5] and [got["red ring", i] for i in (1, 2, 3)] == [(1, 0), (3, 2), (5, 3)]


def test_refresh_report(spark):
    from annalist.operators.curation import refresh_report

    rows = lambda v: spark.createDataFrame(v, "id long, e string, name string")
    before = rows([(1, "a", "Motorhead"), (2, "b", "Slayer"), (3, "b", "Kyuss")])
    after = rows([(1, "a", "Motorhead"), (2, "b", "SLAYER"), (3, "b", "Kyuss"), (4, "a", "Motorheadd"), (5, "c", "Tool"), (6, "c", "Kyus"), (None, "z", None)])
    got = {(r.kind, r.label): (r.n, r.other) for r in refresh_report(before, after, "id", "e", "name", top=2).collect()}
    assert got[("total", "was")] == (3, None) and got[("total", "now")] == (7, None)
    assert {k[1]: v[0] for k, v in got.items() if k[0] == "added"} == {"c": 2, "a": 1}
    best = lambda x, v: max((difflib.SequenceMatcher(None, x, y).ratio(), y) for y in v)
    assert {k[1]: v for k, v in got.items() if k[0] == "look_alike"} == {x: (round(1000 * best(x, ["motorhead", "slayer", "kyuss"])[0]), y) for x, y in (("motorheadd", "motorhead"), ("kyus", "kyuss"))}


def test_possible_pairs(spark):
    """One owner's titles, as values: why two are one, and what is not."""
    titles = ["Gold Dust", "Golddust", "A Song for the Dead", "Song for the Dead", "Total Hate", "Total Hate '95", "Harvest", "Harvest Moon", "Vermilion", "Vermilion Pt. 2", "Parabol", "Parabola", "Comin' Home", "Coming Home", "War", "Wars", "Intro", "Intros", "Gold  dust"]
    df = spark.createDataFrame([(i, i == 99, t) for i, t in enumerate(titles)] + [(50, True, "Parabolas"), (51, False, None)], "k long, o boolean, t string")
    got = {(titles[r.a], titles[r.b]): (r.reason, r.score) for r in M.possible_pairs(df, "k", "o", "t").collect()}
    assert got.pop(("Parabol", "Parabola"))[0] == "spelling" and got.pop(("Comin' Home", "Coming Home"))[0] == "spelling"
    assert got == {("Gold Dust", "Golddust"): ("spacing", 100.0), ("A Song for the Dead", "Song for the Dead"): ("article", 97.0), ("Total Hate", "Total Hate '95"): ("suffix", 95.0)}
    gone = spark.createDataFrame([(1, 0), (4, 5)], "a long, b long")
    left = {(r.a, r.b) for r in M.possible_pairs(df, "k", "o", "t", gone).collect()}
    assert (0, 1) not in left and (4, 5) not in left and (2, 3) in left
