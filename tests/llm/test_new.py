"""Ranked search, toxicity and the conversation trie against plain versions, and on odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from annalist.llm import search, toxicity, trie

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
EXTRA = "x long, block string, h long, score string"


def terms(t):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def ranked(docs, items, most):
    tfs = [(i, Counter(terms(t))) for i, t in docs]
    tfs = [(i, c) for i, c in tfs if c]
    N, L = len(tfs), sum(sum(c.values()) for _, c in tfs)
    df = Counter(t for _, c in tfs for t in c)
    out = set()
    for item, text in items:
        scores = []
        for i, c in tfs:
            m = 50 + 50 * sum(c.values()) * N // L
            s = sum(math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out |= {(item, nth, None if none else i, -s) for nth, (s, none, i) in enumerate(sorted(scores)[:most], 1)}
    return out


@pytest.mark.parametrize("how", [{}, {"block": 3, "bundle": 2, "bits": 1 << 8}, {"block": 5, "owners": (9, 4, 2)}])
def test_ranked_search(spark, monkeypatch, how):
    rng = random.Random(len(how))
    vocabulary = [f"{c}{'é' if i % 3 else ''}{i}" for i, c in enumerate("abcdefghijklmnopqrstuvwxyz" * 2)]
    weights = [1 / (1 + i) for i in range(len(vocabulary))]
    text = lambda n: ", ".join(x.upper() if rng.random() < 0.2 else x for x in rng.choices(vocabulary, weights, k=n))
    docs = [(i, text(rng.randint(1, 40))) for i in range(60)] + [(60, None), (61, ""), (62, ".,;"), (63, "a0 " * 5000), (None, text(9)), (7, "b1 c2"), (7, "b1 c2")]
    items = [(i, text(rng.randint(1, 12))) for i in range(7)] + [(7, None), (8, ""), (9, "unknown"), (None, text(5))]
    if how:
        monkeypatch.setattr(search, "BROADCAST_ROWS", 0)
        monkeypatch.setattr(search, "CHUNK", 64)
    d = spark.createDataFrame([(i, t, 1, "b", 1, "s") for i, t in docs], "doc_id long, text string, " + EXTRA).repartition(3)
    b = spark.createDataFrame([(i, t, 1, "b", 1, "s") for i, t in items], "item_id long, text string, " + EXTRA)
    for most in (3, 50):
        got = search.rank(d, b, most=most, **how)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert {tuple(r) for r in got.collect()} == ranked(docs, items, most)
    assert search.rank(d.limit(0), b).count() == 0 and search.rank(d, b.limit(0)).count() == 0


def plain_trie(turns):
    own = {}
    for c, turn, role, text in turns:
        if c is not None:
            own.setdefault(c, []).append(((turn is not None, turn or 0), (role or "", text or "")))
    own = {c: [t for _, t in sorted(v, key=lambda x: x[0])] for c, v in own.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = own.get(c - int(math.fmod(c, 5)), [])[:h] + v[h:]
    node = {}
    for c, v in built.items():
        for d in range(len(v) + 1):
            node.setdefault(tuple(v[:d]), []).append(c)
    kids = Counter(p[:-1] for p in node if p)
    saved, leaves = Counter(), Counter()
    for p, members in node.items():
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(members) - 1) * (len(p[-1][1].encode()) if p else 0)
            leaves[p[:d]] += p not in kids
    return sorted((min(m), len(p), min(node[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(c for c in m if len(built[c]) == len(p)))).encode()).hexdigest()) for p, m in node.items())


@pytest.mark.parametrize(("width", "stretch"), [(8, 4096), (3, 4), (2, 2)])
def test_trie(spark, monkeypatch, width, stretch):
    monkeypatch.setattr(trie, "STRETCH", stretch)
    rng = random.Random(width)
    turns = []
    for c in [*range(-7, 40), 1000, 1003]:
        for t in range(rng.choice([1, 2, 3, 5, 9, 12, 30])):
            turns.append((c, None if t == 0 else t, rng.choice(["user", None]) if t % 2 == 0 else "assistant", rng.choice(["hé", "yo", None, "x" * 50])))
    turns += [(None, 1, "user", "lost"), (77, 0, "user", "y" * 300_000)]
    rng.shuffle(turns)
    df = spark.createDataFrame([(*t, 1, "b", 1, "s") for t in turns], "conv_id long, turn long, role string, text string, " + EXTRA).repartition(3)
    got = trie.trie(df, width=width)
    assert sorted((tuple(r) for r in got.collect()), key=lambda r: (r[0], r[1])) == sorted(plain_trie(turns), key=lambda r: (r[0], r[1]))
    assert trie.trie(df.limit(0)).count() == 0 and trie.trie(df.where("conv_id is null")).count() == 0


def test_trie_ties(spark):
    """Turns of one number, and repeated ones, go in one order whatever order they come in."""
    rows = [(1, 3, "user", x) for x in "abcabc"] + [(2, None, "user", x) for x in "aab"]
    runs = [sorted(map(tuple, trie.trie(spark.createDataFrame(r, "conv_id long, turn long, role string, text string").repartition(k)).collect()), key=repr) for k, r in ((1, rows), (3, rows[::-1]))]
    assert runs[0] == runs[1]


def plain_kernel(a, b):
    def parts(w):
        s, out = [0, *(int(toxicity._SYMBOL[c]) for c in w), 0], Counter()
        for i in range(len(s)):
            for j in range(i + 1, len(s)):
                for k in range(j + 1, min(len(s), i + toxicity.SPAN)):
                    out[s[i], s[j], s[k]] += toxicity.DECAY ** (k - i + 1)
        return out

    x, y = parts(a), parts(b)
    return sum(v * y[c] for c, v in x.items()) / math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))


def test_subsequence_kernel():
    names = [b"idiot", b"iddiot", b"house", b"aaaaaa", b"abc", b"worthlessness", "réeux".encode()]
    marks = toxicity.columns(names)
    k = toxicity.kernel(names, marks)
    assert all(abs(k[i, j] - plain_kernel(a, b)) < 1e-5 for i, a in enumerate(names) for j, b in enumerate(names))
    # Values from one running sum over a text are those of words alone, however they stand in it.
    rng = np.random.default_rng(1)
    alpha = rng.normal(size=len(names))
    m = toxicity.Machine(marks @ alpha, -0.1)
    text = b"The id.iot, of a h o u s e! abc\n" + "réeux aaaaaa worthlessness".encode()
    plain = [b"the", b"idiot", b"of", b"ahouse", b"abc", "réeux".encode(), b"aaaaaa", b"worthlessness"]
    want = [sum(al * plain_kernel(w, n) for al, n in zip(alpha, names, strict=True)) - 0.1 for w in plain]
    got = m.values([text, None, b"", b" . ", b"idiot"])
    assert abs(got[0, 0] - max(toxicity.FLOOR, *want)) < 1e-4 and abs(got[0, 1] - sum(min(1, max(0, f)) for f in want)) < 1e-4
    assert got[:, 2].tolist() == [8, 0, 0, 0, 1] and (got[1:4, 0] == toxicity.FLOOR).all()


def made(rng, bad, n):
    words = ["".join(rng.choice(list("aeioulnrst"), int(rng.integers(3, 9)))) for _ in range(n)]
    for i in rng.choice(n, max(1, n // 12), replace=False) if bad else ():
        words[i] = str(rng.choice(["idiot", "scumbag", "moronic"]))
    return " ".join(words)


def test_toxicity(spark):
    """Held-out rows, and insults that are gapped or have letters put in, none of which are in the labelled rows."""
    rng = np.random.default_rng(3)
    rows = [(i, made(rng, i % 4 == 0, int(rng.integers(20, 80))), int(i % 4 == 0)) for i in range(800)]
    odd = [(9000, None), (9001, ""), (9002, "  "), (None, "idiot"), (9003, "x" * 3_000_000), (9004, "lone " * 300_000 + "moronic"), (9005, rows[0][1]), (9005, rows[0][1])]
    hidden = [f"{made(rng, False, 12)} {w} {made(rng, False, 6)} {v}" for w, v in [("i d i o t", "s-c-u-m-b-a-g"), ("idixot", "mo.ron.ic"), ("scuumbag", "moroniic"), ("mor-onic", "idiott")]]
    docs = spark.createDataFrame([(i, t, 1, "b", 1, "s") for i, t in [*[r[:2] for r in rows], *odd, *((9100 + k, t) for k, t in enumerate(hidden))]], "doc_id long, text string, " + EXTRA)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (9001, None), (70000, 1)], "doc_id long, toxic int")
    got = toxicity.score(docs, labels)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    found = {}
    for r in got.collect():
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        found.setdefault(r.doc_id, []).append(r)
    out = [(found[i][0].predicted, y) for i, _, y in rows if found[i][0].held_out]
    assert len(out) > 100 and sum(p == y for p, y in out) / len(out) > 0.97
    assert all(found[9100 + k][0].predicted for k in range(len(hidden)))
    assert len(found[9005]) == 2 and found[9005][0].score == found[9005][1].score == found[0][0].score
    assert not any(found[i][0].predicted for i in (9000, 9001, 9002, 9003))
    # Labels of held-out rows change nothing.
    flipped = labels.selectExpr("doc_id", "if(crc32(cast(cast(doc_id as string) as binary)) % 5 = 0, 1 - toxic, toxic) as toxic")
    assert sorted(map(tuple, toxicity.score(docs, flipped).select("doc_id", "score").na.fill(-1).collect())) == sorted(map(tuple, got.select("doc_id", "score").na.fill(-1).collect()))
    assert {tuple(r) for r in toxicity.score(docs, labels.where("toxic = 0")).select("score", "predicted").distinct().collect()} == {(0.0, 0)}
    assert toxicity.score(docs.limit(0), labels).count() == 0 and toxicity.score(docs, labels.limit(0)).where("score = 0").count() == docs.count()
