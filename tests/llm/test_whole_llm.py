"""Inputs on which an operator once did less than its whole job."""

import numpy as np
import pytest

from annalist.llm import decontaminate, jaccard


def words(rng, n):
    return [f"w{x}" for x in rng.integers(0, 1 << 40, n)]


@pytest.mark.parametrize("copies", [30, 1000])
def test_jaccard_appended(spark, copies):
    """One text and copies that each append words: they are linked with it, not among themselves."""
    rng = np.random.default_rng(copies)
    body = words(rng, 84)
    rows = [body, *(body + words(rng, 20) for _ in range(copies))]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in rows]
    assert all(4 * len(sets[0] & s) >= 3 * len(sets[0] | s) for s in sets)
    at = copies // 2  # the original is neither the first row nor the smallest id
    rows[0], rows[at] = rows[at], rows[0]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string")
    got = {(r.doc_id, r.component_id) for r in jaccard.link(df, sample=1).collect()}
    assert got == {(i, 0) for i in range(len(rows))}


def test_decontaminate_replaced(spark):
    """Items with words replaced, near their ends too, against every stretch of every alignment."""
    rng = np.random.default_rng(5)
    items = {n: words(rng, n) for n in (5, 6, 7, 8, 9, 10, 11, 12, 13, 15, 20, 23, 40)}
    pad, rows = words(rng, 30), []
    for n, item in items.items():
        tries = [{0}, {n - 1}, {1}, {1, n - 2}, {0, n // 2}, {1, n // 2, n - 2}, *(set(rng.choice(n, min(n, int(rng.integers(1, 1 + n // 3 + 1))), replace=False).tolist()) for _ in range(25))]
        rows += [(n, pad + ["x" if i in gone else w for i, w in enumerate(item)] + pad) for gone in tries]

    def found(doc, item):
        need = min(12, len(item))
        for shift in range(need - len(item), len(doc) - need + 1):
            same = [0 <= i + shift < len(doc) and doc[i + shift] == w for i, w in enumerate(item)]
            total = np.concatenate([[0], np.cumsum(same)])
            if any(5 * (total[j] - total[i]) >= 4 * (j - i) for i in range(len(item)) for j in range(i + need, len(item) + 1) if 0 <= i + shift and j + shift <= len(doc)):
                return True
        return False

    want = {(k, n) for k, (n, doc) in enumerate(rows) if found(doc, items[n])}
    docs = spark.createDataFrame([(k, " ".join(doc)) for k, (_, doc) in enumerate(rows)], "doc_id long, text string")
    got = decontaminate.overlaps(docs, spark.createDataFrame([(n, " ".join(w)) for n, w in items.items()], "item_id long, text string")).collect()
    assert len(want) < len(rows) and {(r.doc_id, r.item_id) for r in got} == want
    assert all(r.n_words >= min(12, r.item_id) and 5 * r.n_same >= 4 * r.n_words for r in got)


@pytest.mark.parametrize("n", [1, 60, 1000, 6000])
def test_jaccard_parity(spark, n):
    """Bitmaps let every linked pair by, whichever of both is larger, and tell sets of any size apart, so that few sets are sent that have no link."""
    rng = np.random.default_rng(n)
    body, more = np.split(np.unique(rng.integers(0, 1 << 63, 3 * n + 9).astype(np.uint64)), [n])
    linked = [body, body[: max(1, n * 3 // 4)], np.concatenate([body, more[: n // 3]]), np.concatenate([body[: n - n // 8], more[: n // 8]])]
    apart = [np.concatenate([body[: n // 2], more[: n - n // 2]]), more[:n]] if n > 1 else []
    rows = [(k, len(t), jaccard._parity(t).tolist()) for k, t in enumerate(linked + apart)]
    light = spark.createDataFrame(rows, "k long, n long, parity array<long>")
    pairs = spark.createDataFrame([x for k in range(1, len(rows)) for x in ((0, k), (k, 0))], "a long, b long")
    got = {(r.a, r.b) for r in jaccard._near(pairs, light, 3, 4).collect()}
    assert got == {x for k in range(1, len(linked)) for x in ((0, k), (k, 0))}


def test_jaccard_bitmaps_smaller(spark):
    """Bitmaps laid together at a fraction of the larger one's bits, as a low ratio allows."""
    rng = np.random.default_rng(8)
    body = np.unique(rng.integers(0, 1 << 63, 4000).astype(np.uint64))
    sets = [body, body[:1000], body[:120]]
    light = spark.createDataFrame([(k, len(t), jaccard._parity(t).tolist()) for k, t in enumerate(sets)], "k long, n long, parity array<long>")
    apart = [jaccard._parity(sets[0]).reshape(-1, len(jaccard._parity(t))) for t in sets]
    for k in (1, 2):  # a whole bitmap laid on itself is the bitmap of fewer bits
        bits = 64 * apart[k].shape[1]
        odd = np.bincount((body >> np.uint64(24)).astype(np.int64) % bits, minlength=bits) & 1
        assert np.bitwise_xor.reduce(apart[k], axis=0).tolist() == np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()
    pairs = spark.createDataFrame([(0, 1), (2, 1)], "a long, b long")
    assert {(r.a, r.b) for r in jaccard._near(pairs, light, 1, 9).collect()} == {(0, 1), (2, 1)}
