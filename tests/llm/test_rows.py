"""Rows that are odd: null and repeated ids, copies of a row, clashing columns, no rows; and groups of near copies, whatever the sizes from which they are split."""

import numpy as np
import pytest

import corpus_pipeline
from annalist.llm import decontaminate, exact, jaccard, licences, packing, personal, quality, registry, secret_scan, substrings, urls

DATA = "/root/testdata/sf0.001"
T = "the quick brown fox jumps over the lazy dog while a second fox looks on and a third one sleeps under some old tree"


def words(rng, n):
    return [f"w{x}" for x in rng.integers(0, 1 << 40, n)]


@pytest.mark.parametrize(("few", "meet"), [(8, 4096), (2, 4)])
def test_near_copy_groups(spark, few, meet):
    """Bases and copies with words replaced, near the threshold and chained, against every pair."""
    rng = np.random.default_rng(few)
    rows = []
    for base in range(3):
        body = words(rng, 90)
        clumps = [body] + [[w if rng.random() > 0.06 else f"c{base}{k}{i}" for i, w in enumerate(body)] for k in range(3)]
        for c in clumps:
            for _ in range(14):
                rate = rng.choice([0.0, 0.01, 0.02, 0.03, 0.05])
                rows.append([w if rng.random() > rate else words(rng, 1)[0] for w in c][: int(rng.integers(70, 91))])
    rows += [words(rng, 60) + rows[0][:40] for _ in range(20)]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            if 4 * len(sets[a] & sets[b]) >= 3 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in jaccard.link(df, sample=1, few=few, meet=meet).collect()}
    assert got == {i: find(i) for i in range(len(rows))}
    assert 6 < len(set(got.values())) < len(rows) - 40


def test_stages(spark, tmp_path):
    rows = [(None, T, "x"), (None, T, "x"), (1, T, "y"), (2, T, "z"), (2, T, "z"), (3, None, "q"), (4, T + " tail", "w"), (4, "### %%% ### $$$ @@@ ### %%% !!!", "w"), (None, "### %%% ### $$$ @@@ ### %%% !!!", "w")]
    schema = "doc_id long, text string, row string"
    spark.createDataFrame(rows, schema).coalesce(2).write.parquet(str(tmp_path / "docs"))
    none = spark.createDataFrame([], schema)
    for docs in (spark.createDataFrame(rows, schema), spark.read.parquet(str(tmp_path / "docs"))):
        run = lambda f: sorted(((r.doc_id or 0, r.text or "", r.row) for r in f(spark, docs, DATA).collect()))
        odd = rows[-1][1]
        assert run(corpus_pipeline.exact_stage) == sorted([(2, T, "z"), (3, "", "q"), (4, T + " tail", "w"), (4, odd, "w")])
        near = run(corpus_pipeline.near_stage)
        assert (1, T, "y") in near and len(near) == 3 and {x[1] for x in near} == {T, "", odd}
        good = run(corpus_pipeline.quality_stage)
        assert (3, "", "q") not in good and len([x for x in good if x[1] == T]) == 5
        assert len(run(corpus_pipeline.decontamination_stage)) == len(rows)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, DATA).count() == 0, name


def test_clashing_columns_and_repeats(spark):
    """Columns named like the operators' own are not read; each repeated row has its own result."""
    text = "Released under the MIT License. id ABC1XYZABCDEFGH and key 0123456789abcdef0123 call +49 30 1234567"
    plain = [(1, text), (1, text), (None, text), (2, None)]
    df = spark.createDataFrame([(i, t, 1, 2, "k", "h", 3, "x", "y", True) for i, t in plain], "doc_id long, text string, n long, k long, t string, h string, start long, bin string, licence string, keep boolean")
    for f in (quality.score, personal.find, secret_scan.scan, exact.dedup, substrings.remove_repeats, jaccard.link):
        assert sorted((r.doc_id or 0) for r in f(df).collect()) == [0, 1, 1, 2], f
    assert sorted((r.doc_id or 0, r.licence, r.n_windows) for r in licences.scan(df).collect()) == [(0, "MIT", 1), (1, "MIT", 1), (1, "MIT", 1)]
    assert sorted((r.doc_id or 0) for r in packing.pack(df, registry.vocabulary()).collect() if r.start == 0) == [0, 1, 1, 2]
    items = spark.createDataFrame([(7, text, "s", 1)], "item_id long, text string, seed string, words long")
    assert {(r.doc_id, r.item_id) for r in decontaminate.overlaps(df, items).collect()} == {(1, 7)}
    pages = spark.createDataFrame([(1, "http://b.net/x", "h", "p", 1), (1, "http://b.net/x", "h", "p", 1), (None, None, "h", "p", 1)], "page_id long, url string, host string, path string, n long")
    assert sorted((r.page_id or 0, r.verdict) for r in urls.judge(pages).collect()) == [(0, "allow"), (1, "block"), (1, "block")]
    assert urls.judge(pages.limit(0)).count() == 0


def test_licences_long(spark):
    """A licence wrapped anywhere, in a long text, in one line or many; and a text of many distinct signs between its words."""
    body = " ".join(licences._MIT)
    w = body.split()
    filler = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, filler + " " + body + " " + filler), (2, filler + "\n" + "\n# ".join(" ".join(w[i : i + 9]) for i in range(0, len(w), 9)) + "\n" + filler), (3, " ".join(f"{x} {'§' * (i + 1)}" for i, x in enumerate(w))), (4, filler), (5, "This work is licensed under the GNU General Public License, version 3.")]
    got = {(r.doc_id, r.licence) for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {(1, "MIT"), (2, "MIT"), (3, "MIT"), (5, "GPL-3.0")} == got
