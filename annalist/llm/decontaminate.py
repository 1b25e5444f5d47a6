"""Benchmark decontamination by spaced seeds.

A mask looks at some of the words of a window and ignores the others, so a passage with single words replaced still
shares a seed with its source. The masks follow from the thresholds, so that every stretch that meets them has a seed.
Seeds of benchmark items and documents meet in a join; around each hit the two are laid on one another word by word,
and the best stretch that meets the thresholds decides.
"""

from __future__ import annotations

from fractions import Fraction
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bitmap, gram_hashes, in_bitmap, mix, pieces, stored, texts, word_hashes

_PUNCTUATION = bytes(range(33, 48)) + bytes(range(58, 65)) + bytes(range(91, 97)) + bytes(range(123, 127))


def _words(data: list[bytes | None]) -> list[np.ndarray]:
    return word_hashes([t.translate(None, _PUNCTUATION) if t else t for t in data], lower=True)


def _pairs(need: int, least: Fraction) -> tuple[int, tuple[int, ...]]:
    """Length and distances of two runs of equal words of which every stretch of `need` words or more, `least` of them
    equal, has a pair. Of a stretch of 2 need words or more one half will do. A shorter one of L words with k replaced,
    cut into runs of c words, keeps two whole among the first k + 2 if it has so many.
    """
    lost = {size: int((1 - least) * size) for size in range(need, 2 * need)}
    c = min(size // (k + 2) for size, k in lost.items())
    return (c, tuple(c * i for i in range(1, max(lost.values()) + 2))) if c else (1, (0,))


def _whole(n: int, least: Fraction) -> list[list[int]]:
    """The places that the masks of an item of n words look at: any k of k + 4 parts left out, k words being replaced at most."""
    k = int((1 - least) * n)
    parts = np.array_split(np.arange(n), min(n, k + 4))
    return [sorted(set(range(n)) - {int(x) for part in out for x in part}) for out in combinations(parts, k)]


def _seeds(words: np.ndarray, pairs: tuple[int, tuple[int, ...]] | None, short: tuple[int, ...], least: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """(seed, position) of every pair of runs at every place, and of every mask of items of the lengths `short`."""
    out = []
    if pairs:
        runs = gram_hashes(words, pairs[0])
        out += [mix(runs[: len(runs) - d] * np.uint64(0xD6E8FEB86659FD93) + runs[d:] + np.uint64(d)) for d in pairs[1] if d < len(runs)]
    for n in short:
        m = len(words) - n + 1
        for number, places in enumerate(_whole(n, least) if m > 0 else ()):
            h = np.full(m, n << 32 | number + 1, np.uint64)
            for j in places:
                h = h * np.uint64(0xD6E8FEB86659FD93) + words[j : j + m]
            out.append(mix(h))
    if not out:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(out), np.concatenate([np.arange(len(h)) for h in out])


def _best(same: np.ndarray, need: int, least: Fraction) -> tuple[int, int] | None:
    """Of the stretches of `need` words or more, `least` of them equal, the one with the most points: one for each equal word, two off for each other."""
    run = np.concatenate([[0], np.cumsum(np.where(same, 1, -2))])
    over = np.concatenate([[0], np.cumsum(np.where(same, least.denominator - least.numerator, -least.numerator))])
    end = int(np.argmax(run - np.minimum.accumulate(run)))
    start = int(np.argmin(run[: end + 1]))
    if end - start >= need and over[end] >= over[start]:
        return start, end
    ends = need + np.flatnonzero(over[need:] >= np.minimum.accumulate(over)[: max(0, len(over) - need)])
    found = []
    for end in ends.tolist():
        starts = np.flatnonzero(over[: end - need + 1] <= over[end])
        start = int(starts[np.argmin(run[starts])])
        found.append((int(run[end] - run[start]), -start, end))
    if not found:
        return None
    _, start, end = max(found)
    return -start, end


def overlaps(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", least_words: int = 12, identity: float = 0.8, bits: int = 1 << 24, shortest: int = 5) -> DataFrame:
    """Passages of items within documents, with single words replaced or not.

    One row per document and item with an overlap: doc_id, item_id, doc_start, item_start, n_words, n_same: the best
    stretch (a point for each equal word, two off for each other) among those of least_words words or more, or of the
    whole item if that is shorter, with `identity` of their words equal. No such stretch is missed. Words are compared in lower case, without ASCII punctuation.
    Null or empty texts and items, and items under `shortest` words (1: none), which say little of where a text is from: no row. Null doc_id or item_id: left out. Repeated rows:
    as one. Ties: of equally good stretches the one that starts first. Other columns, whatever their names, are not read. A very long text: hashed in pieces; only the surroundings of hits leave the task. Empty tables: no rows.
    bits: size of the bitmap of items' seeds by which documents' seeds are sifted before the join.
    """
    docs = texts(docs, id_col, text_col).where("doc_id is not null and text is not null")
    items = items.select(items[item_col].cast("long").alias("item_id"), items[item_text].cast("string").alias("text")).where("item_id is not null and text is not null")
    spark = docs.sparkSession
    least = Fraction(str(identity))
    runs = _pairs(least_words, least)

    def item_words(batches):
        for ids, data, _ in pieces(batches):
            got = _words(data)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([w.tobytes() for w in got], pa.binary()), pa.array([len(w) for w in got], pa.int32())], ["item_id", "words", "n"])

    known = stored(items.mapInArrow(item_words, "item_id long, words binary, n int").where(f"n >= {max(1, shortest)}"))
    # At most least_words lengths.
    short = tuple(sorted(r["n"] for r in known.where(f"n < {least_words}").select("n").distinct().collect()))
    longest = known.agg(F.max("n").alias("n")).first()["n"] or 0
    pairs = runs if longest >= least_words else None

    def item_seeds(batches):
        for b in batches:
            for item, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                w = np.frombuffer(data, np.uint64)
                h, at = _seeds(w, None, (len(w),), least) if len(w) < least_words else _seeds(w, runs, (), least)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.full(len(h), item, np.int64)), pa.array(at)], ["seed", "item_id", "item_at"])

    tests = stored(known.select("item_id", "words").mapInArrow(item_seeds, "seed long, item_id long, item_at long"))
    sieve = spark.sparkContext.broadcast(bitmap(tests.select("seed").distinct(), "seed", bits))

    def segments(batches):
        """(doc_id, seg_start, words, seeds, places): stretches of a document around its hits."""
        for ids, data, _ in pieces(batches):
            out = []
            for doc, w in zip(ids, _words(data), strict=True):
                h, at = _seeds(w, pairs, short, least)
                hit = in_bitmap(sieve.value, bits, h)
                if not hit.any():
                    continue
                h, at = h[hit], at[hit]
                order = np.argsort(at, kind="stable")
                h, at = h[order], at[order]
                for part in np.split(np.arange(len(at)), np.flatnonzero(np.diff(at) > 2 * longest) + 1):
                    a, b = max(0, at[part[0]] - longest), at[part[-1]] + longest
                    out.append((doc, a, w[a:b].tobytes(), h[part].view(np.int64).tolist(), (at[part] - a).tolist()))
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True) if out else [()] * 5, (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())), strict=True)], ["doc_id", "seg_start", "words", "seeds", "places"])

    segs = stored(docs.mapInArrow(segments, "doc_id long, seg_start long, words binary, seeds array<long>, places array<long>"))
    hits = segs.select("doc_id", "seg_start", F.explode(F.arrays_zip("seeds", "places")).alias("h")).select("doc_id", "seg_start", F.col("h.seeds").alias("seed"), F.col("h.places").alias("at"))
    lain = hits.join(tests, "seed").select("doc_id", "seg_start", "item_id", (F.col("at") - F.col("item_at")).alias("shift")).distinct()

    def verify(batches):
        for b in batches:
            out = []
            for doc, seg, item, shift, mine, theirs in zip(*(c.to_pylist() for c in b.columns), strict=True):
                d, t = np.frombuffer(mine, np.uint64), np.frombuffer(theirs, np.uint64)
                a = max(0, -shift)
                n = min(len(t), len(d) - shift) - a
                if n < shortest:
                    continue
                same = t[a : a + n] == d[a + shift : a + shift + n]
                if stretch := _best(same, min(least_words, len(t)), least):
                    start, end = stretch
                    out.append((doc, item, seg + a + shift + start, a + start, end - start, int(same[start:end].sum())))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*out, strict=True) if out else [()] * 6)], ["doc_id", "item_id", "doc_start", "item_start", "n_words", "n_same"])

    checked = (
        lain.join(segs.select("doc_id", "seg_start", "words"), ["doc_id", "seg_start"])
        .join(known.select("item_id", F.col("words").alias("item_words")), "item_id")
        .select("doc_id", "seg_start", "item_id", "shift", "words", "item_words")
        .mapInArrow(verify, "doc_id long, item_id long, doc_start long, item_start long, n_words long, n_same long")
    )
    best = F.max(F.struct("n_same", -F.col("n_words"), -F.col("doc_start"), -F.col("item_start"))).alias("b")
    return checked.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", (-F.col("b.col3")).alias("doc_start"), (-F.col("b.col4")).alias("item_start"), (-F.col("b.col2")).alias("n_words"), F.col("b.n_same").alias("n_same"))
