"""Each stage of the pipeline on what its predecessor kept, against a plain Python version."""

import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from annalist.llm import decontaminate, registry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    """The documents, then what each stage returned."""
    folder, out = tmp_path_factory.mktemp("stages"), [spark.read.parquet(f"{DATA}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, out[-1], DATA).write.parquet(f"{folder}/{name}")
        out.append(spark.read.parquet(f"{folder}/{name}"))
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def test_columns(kept):
    assert all(df.columns == kept[0].columns for df in kept[:-1])


def test_quality(spark, kept):
    """Held-out labels: the classifier has seen none."""
    ids = set(texts(kept[1]))
    labels = [(r.doc_id in ids, r.quality) for r in spark.read.parquet(f"{DATA}/labels.parquet").where("quality is not null").collect()]
    good = [k for k, q in labels if q == 1]
    bad = [k for k, q in labels if q == 0]
    assert good and sum(good) >= 0.95 * len(good), (sum(good), len(good))
    assert sum(bad) <= 0.25 * len(bad), (sum(bad), len(bad))


def test_exact(kept):
    last = {}
    for i, t in texts(kept[1]).items():
        last[t or ""] = max(i, last.get(t or "", i))
    assert set(texts(kept[2])) == set(last.values())


def test_near(kept):
    words = {i: [w for w in (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w] for i, t in texts(kept[2]).items()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for i, w in words.items()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert set(texts(kept[3])) == {i for i in sets if root[i] == i}


def test_decontamination(spark, kept):
    """Gone: every document with twelve words in a row, or all words, of an item; and none without a stretch of enough equal words."""
    number: dict = {}
    plain = lambda t: np.array([number.setdefault(w, len(number)) for w in (t or "").encode().translate(None, decontaminate._PUNCTUATION).lower().split()], np.int64)
    items = [w for t in {r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()} if len(w := plain(t)) >= 5]
    before, after = texts(kept[3]), texts(kept[4])
    must, may = set(), set()
    for i, t in before.items():
        d = plain(t)
        for item in items:
            padded = np.concatenate([np.full(len(item), -1), d, np.full(len(item), -1)])
            same = np.lib.stride_tricks.sliding_window_view(padded, len(item)) == item
            need = min(12, len(item))
            for row in same[same.sum(1) >= 0.8 * need]:
                may.add(i)
                if max(map(len, "".join("x" if s else " " for s in row).split())) >= need:
                    must.add(i)
    gone = set(before) - set(after)
    assert must and must <= gone <= may


def test_packing(kept):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(registry.vocabulary())
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for i, t in texts(kept[4]).items()}
    pieces = kept[5].orderBy("doc_id", "start").collect()
    at = dict.fromkeys(ids, 0)
    for r in pieces:
        assert r.start == at[r.doc_id] and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
        at[r.doc_id] += r.length
    assert at == {i: len(x) for i, x in ids.items()}
    end: dict = {}
    for r in sorted(pieces, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == end.get(r.sequence_id, 0)
        end[r.sequence_id] = r.offset + r.length
    assert max(end.values()) <= 2048
