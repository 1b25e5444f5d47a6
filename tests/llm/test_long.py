"""Very long words and numbers, and links of secrets at every distance."""

import resource
import time

import numpy as np
import pytest

from annalist.llm import common, decontaminate, packing, personal, secret_scan


def test_words_cut_anywhere(monkeypatch):
    """Hashes do not depend on where a text is cut, between words or in them."""
    rng = np.random.default_rng(2)
    texts = [bytes(rng.choice(list(b"ab \n\tAB"), int(n))) for n in rng.integers(1, 400, 200)] + [b"x" * 300, b" " * 99, b"a" * 64 + b" b", b"a" * 63 + b" " + b"b" * 64]
    whole = [common.word_hashes([t], lower)[0].tolist() for t in texts for lower in (False, True)]
    for chunk in (7, 64):
        monkeypatch.setattr(common, "CHUNK", chunk)
        assert [common.word_hashes([t], lower)[0].tolist() for t in texts for lower in (False, True)] == whole


def test_one_long_word():
    """64 MB without white space: hashed in pieces, in memory that is a small part of it."""
    word = b"x" * 64_000_000
    common.word_hashes([b"warm up"])
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert len(common.word_hashes([word])[0]) == 1
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 300_000  # kB


def test_long_runs_of_digits():
    t = time.time()
    spans = personal.base_spans("see 10.2.3.4 " + "7" * 1_000_000 + ".1.2.3 and " + "1." * 200_000 + " x")
    assert time.time() - t < 10 and spans[0] == (4, 1, 12)
    assert personal.base_spans("v1.2.3.4.5.6.7.8 999.1.1.1 1..2.3.4.5")[:2] == [(1, 1, 8), (9, 1, 16)]


@pytest.mark.parametrize("length", [24, 700, 3000])
def test_links_at_every_distance(spark, length):
    """A weak key and an access id, either first, at every offset modulo the scope."""
    key = ("k3y" + "Zq" * 2000)[: length]
    rows, want = [], set()
    for offset in range(0, 500, 23):
        for gap in (1, 2, 250, 487, 499, 500, 501, 520):
            for first in (True, False):
                a, b = (key, "AKIA" + "B" * 16) if first else ("AKIA" + "B" * 16, key)
                i = len(rows)
                rows.append((i, "." * offset + " " + a + " " * gap + b + " "))
                if gap <= 500:
                    want.add(i)
    got = secret_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in got if any(s.kind == "weak_secret" for s in r.spans)} == want
    assert all(len([s for s in r.spans if s.kind == "access"]) == 1 and len(r.spans) == 1 + (r.doc_id in want) for r in got)


def test_short_items(spark):
    """With shortest = 1, items of one to four words are found whole."""
    docs = spark.createDataFrame([(1, "some words here"), (2, "none of it"), (3, "rare thing, indeed so")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "here"), (2, "of it"), (3, "rare thing indeed"), (4, "a rare thing")], "item_id long, text string")
    run = lambda n: {(r.doc_id, r.item_id) for r in decontaminate.overlaps(docs, items, shortest=n).collect()}
    assert run(1) == {(1, 1), (2, 2), (3, 3)} and run(2) == {(2, 2), (3, 3)} and run(5) == set()


def test_word_cache_is_bounded():
    """Long words are encoded as ever, but not remembered."""
    import public_tokenizers

    encode = packing._encoder(public_tokenizers.path("word_bpe_49k.json"), 1000)
    tok, known = packing._tokenizers[public_tokenizers.path("word_bpe_49k.json")]
    texts = [" ".join(f"w{i}x{'ab' * 100}{k}" for k in range(20)).encode() for i in range(200)]
    got = encode(texts)
    assert all(max(map(len, held), default=0) <= packing.KEPT_WORD and len(held) < 1500 for held in (known, known.parts))
    assert all(g.tolist() == tok.encode(t.decode(), add_special_tokens=False).ids for g, t in zip(got[::20], texts[::20], strict=True))
