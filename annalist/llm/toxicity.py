"""Toxicity: a support vector machine over a gap-weighted subsequence kernel of words, through Nyström landmarks."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import _SPACE, CHUNK, _parts, pieces, stored, texts

#: The kernel compares subsequences of three symbols over a span of 7 at most, each weighing DECAY to the power of its span.
SPAN, DECAY = 7, 0.75
_GAPS = [(a, b) for a in range(1, SPAN - 1) for b in range(1, SPAN - a)]
_WEIGHT = {a + b: DECAY ** (a + b + 1) for a, b in _GAPS}
CODES = 32**3
#: Words over WIDTH symbols are judged by windows of that width.
WIDTH = 24
#: Decision values under this one count as this one.
FLOOR = -0.75
SENTENCE = re.compile(rb"[^.!?\n]+")

#: Letters 1 to 26, signs that stand for letters as those, other digits 27, bytes beyond ASCII 28 to 31, all else 0.
_SYMBOL = np.zeros(256, np.int32)
_SYMBOL[48:58] = 27
_SYMBOL[128:] = 28 + np.arange(128) % 4
for _i in range(26):
    _SYMBOL[[65 + _i, 97 + _i]] = _i + 1
for _sign, _letter in zip(b"013457@$", b"oieastas", strict=True):
    _SYMBOL[_sign] = _letter - 96


def windows(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The symbols of a text, and start, end (exclusive) and place in the text of every window: a word with one blank on each side. Signs in and around words are left out, and letters set apart by blanks are one word."""
    a = np.frombuffer(b" " + data + b" ", np.uint8)
    s = _SYMBOL[a]
    place = np.flatnonzero(_SPACE[a] | (s > 0))
    s = s[place]
    edge = np.flatnonzero(np.diff(s > 0, prepend=False, append=False))
    start, end = edge[::2], edge[1::2]
    single = end - start == 1
    gap = np.flatnonzero(single[:-1] & single[1:] & (start[1:] - end[:-1] == 1))
    if len(gap):
        kept = np.ones(len(s), bool)
        kept[end[gap]] = False
        s, place = s[kept], place[kept]
        edge = np.flatnonzero(np.diff(s > 0, prepend=False, append=False))
        start, end = edge[::2], edge[1::2]
    place = place - 1
    start, end = start - 1, end + 1
    long = end - start > WIDTH
    if long.any():
        times = np.where(long, -(-(end - start - WIDTH // 2) // (WIDTH // 2)), 1)
        first = np.repeat(start, times) + (np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)) * (WIDTH // 2)
        end = np.minimum(np.repeat(end, times), np.where(np.repeat(long, times), first + WIDTH, len(s)))
        start = first
    return s, start, end, place[start + 1] if len(start) else start


def sums(s: np.ndarray, start: np.ndarray, end: np.ndarray, table: np.ndarray) -> np.ndarray:
    """For each window the sum of table over its subsequences, by weight: its kernel with all that the table holds."""
    out = np.zeros(len(start))
    if len(s) < 3:
        return out
    high, middle = s << 10, s << 5
    for a, b in _GAPS:
        n = len(s) - a - b
        if n <= 0:
            continue
        total = np.zeros(n + 1)
        np.cumsum(table[high[:n] | middle[a : a + n] | s[a + b : a + b + n]], out=total[1:])
        out += _WEIGHT[a + b] * (total[np.maximum(end - a - b, start).clip(max=n)] - total[np.minimum(start, n)])
    return out


def sparse(s: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, codes and weights of the windows' subsequences, each code of a window once."""
    keys, weights = [], []
    for a, b in _GAPS:
        times = np.maximum(end - start - a - b, 0)
        row = np.repeat(np.arange(len(start)), times)
        i = np.repeat(start, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        keys.append(row.astype(np.int64) * CODES + (s[i] << 10 | s[i + a] << 5 | s[i + a + b]))
        weights.append(np.full(len(i), _WEIGHT[a + b]))
    keys, at = np.unique(np.concatenate(keys), return_inverse=True)
    return keys // CODES, keys % CODES, np.bincount(at, np.concatenate(weights), len(keys))


def norms(s: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    rows, _, w = sparse(s, start, end)
    return np.sqrt(np.bincount(rows, w * w, len(start)))


#: At least the norm of a window by its width.
_LEAST = np.sqrt([max(1e-9, sum(max(0, n - a - b) * _WEIGHT[a + b] ** 2 for a, b in _GAPS)) for n in range(WIDTH + 3)])


def unit(word: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The one window of a word as training keeps it."""
    s = np.concatenate([[0], _SYMBOL[np.frombuffer(word, np.uint8)], [0]]).astype(np.int32)
    return s, np.array([0]), np.array([len(s)])


def kernel(words: list[bytes], landmarks: np.ndarray) -> np.ndarray:
    """Normalised kernel of words with landmarks, columns of length one over CODES."""
    out = np.zeros((len(words), landmarks.shape[1]))
    for i, w in enumerate(words):
        _, codes, weights = sparse(*unit(w))
        if len(codes):
            out[i] = weights @ landmarks[codes] / np.sqrt(weights @ weights)
    return out


def columns(words: list[bytes]) -> np.ndarray:
    out = np.zeros((CODES, len(words)), np.float32)
    for i, w in enumerate(words):
        _, codes, weights = sparse(*unit(w))
        out[codes, i] = weights / np.sqrt(weights @ weights)
    return out


def fit_svm(z: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.5, rounds: int = 30) -> np.ndarray:
    """Weights and bias (last) of a linear machine with squared hinge loss, by Newton steps; y is 1 or -1."""
    z = np.hstack([z, np.ones((len(z), 1))])
    w = np.zeros(z.shape[1])
    keep = np.full(z.shape[1], ridge)
    keep[-1] = 1e-3
    for _ in range(rounds):
        m = 1 - y * (z @ w)
        on = m > 0
        zw = z[on] * weight[on, None]
        new = np.linalg.solve(zw.T @ z[on] + np.diag(keep), zw.T @ y[on])
        if np.abs(new - w).max() < 1e-7:
            break
        w = new
    return w


class Machine:
    """A fitted machine: decision values by one table over codes, as the kernel is a sum over subsequences."""

    def __init__(self, table: np.ndarray, bias: float):
        self.table, self.bias, self.curve = table.astype(np.float32), float(bias), np.zeros(3)

    def values(self, data: list[bytes | None]) -> np.ndarray:
        """Three figures of each text: the highest decision value of its words, FLOOR at least; the sum of those over 0, each counting 1 at most; the number of words. Texts are taken CHUNK bytes at a time."""
        out = np.tile([FLOOR, 0.0, 0.0], (len(data), 1))
        group: list[int] = []
        size = 0

        def flush():
            add(group, self._judged(b"\n".join(data[i] for i in group), np.cumsum([len(data[i]) + 1 for i in group])))
            group.clear()

        def add(rows, figures):
            out[rows, 0] = np.maximum(out[rows, 0], figures[:, 0])
            out[rows, 1:] += figures[:, 1:]

        for i, t in enumerate(data):
            if t and len(t) > CHUNK:
                for p in _parts(t):
                    for at in range(0, len(p), 2 * CHUNK):
                        add([i], self._judged(p[at : at + 2 * CHUNK], np.array([len(p) + 1])))
            elif t:
                if group and size + len(t) > CHUNK:
                    flush()
                    size = 0
                group.append(i)
                size += len(t) + 1
        if group:
            flush()
        return out

    def _judged(self, data: bytes, ends: np.ndarray) -> np.ndarray:
        s, start, end, place = windows(data)
        text = np.searchsorted(ends, place, side="right")
        out = np.tile([FLOOR, 0.0, 0.0], (len(ends), 1))
        out[:, 2] = np.bincount(text, minlength=len(ends))
        if len(start):
            total = sums(s, start, end, self.table)
            may = np.flatnonzero(total / _LEAST[np.minimum(end - start, WIDTH + 2)] + self.bias > FLOOR)
            f = total[may] / norms(s, start[may], end[may]) + self.bias
            np.maximum.at(out[:, 0], text[may], f)
            out[:, 1] = np.bincount(text[may], np.clip(f, 0, 1), len(ends))
        return out

    def score(self, figures: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_measures(figures) @ self.curve, -30, 30)))


def _measures(figures: np.ndarray) -> np.ndarray:
    """What a document's score follows: its worst word, and how many of its words are toxic."""
    return np.stack([figures[:, 0], np.log((figures[:, 1] + 0.1) / (figures[:, 2] + 20)), np.ones(len(figures))], 1)


def fit(positive: list[list[bytes]], negative: list[bytes], rounds: int = 3) -> Machine:
    """A machine from each toxic document's likely words and words of clean ones. Words that are likely in many documents are landmarks and count first. After each round, words count as toxic as far as the last machine holds them so; a document of which it holds none so is likely mislabelled, and hardly counts."""
    words = [w for c in positive for w in c]
    of = np.repeat(np.arange(len(positive)), [len(c) for c in positive])
    names, times = np.unique(np.array(words, object), return_counts=True)
    often = [names[i] for i in np.lexsort((names, -times))[:64] if times[i] >= min(times.max(), max(2, len(positive) ** 0.5 / 3))]
    landmarks = columns(list(dict.fromkeys([*often, *negative[:: max(1, len(negative) // 80)]])))
    values, vectors = np.linalg.eigh((landmarks.T @ landmarks).astype(np.float64))
    some = values > 1e-4
    nystroem = vectors[:, some] / np.sqrt(values[some])
    place = {w: i for i, w in enumerate(names)}
    z_pos, z_neg = (kernel(list(names), landmarks) @ nystroem)[[place[w] for w in words]], kernel(negative, landmarks) @ nystroem
    z = np.vstack([z_pos, z_neg])
    y = np.concatenate([np.ones(len(z_pos)), -np.ones(len(z_neg))])
    sure = np.where([w in often for w in words], 1.0, 0.02)
    for _ in range(rounds):
        w = fit_svm(z, y, np.concatenate([sure * min(20.0, max(1.0, len(z_neg) / len(z_pos))), np.ones(len(z_neg))]))
        f = z_pos @ w[:-1] + w[-1]
        best = np.full(len(positive), -np.inf)
        np.maximum.at(best, of, f)
        sure = np.where(f > 0, 1.0, np.where(best[of] > 0, 0.1, 0.02))
    return Machine(landmarks @ (nystroem @ w[:-1]), w[-1])


def calibrate(figures: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 100) -> np.ndarray:
    """The logistic curve from documents' figures to the share of toxic ones, by damped Newton steps."""
    z = _measures(figures)
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        slope = np.maximum(p * (1 - p), 1e-4) * weight
        step = np.linalg.solve((z * slope[:, None]).T @ z + np.eye(len(w)) * 0.1, z.T @ (weight * (p - y)) + 0.1 * w)
        w = w - step * min(1.0, 2 / max(1e-9, np.abs(step).max()))
    return w


def held_out(id_: Column, folds: int = 5) -> Column:
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % folds == 0, F.lit(True))


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train_docs: int = 4096, words: int = 6000, hard: int = 2000) -> DataFrame:
    """Score every whole text. One row per input row: doc_id, held_out, score (1: surely toxic), predicted (score 0.5 or more).

    A text's score follows its worst word and how many of its words are toxic by the machine; which words of the sentences
    of a toxic document bear its label is found in turns with the machine (multiple-instance learning). train_docs: most documents
    of each label that the machine learns from, those of the smallest hash; words: most words of clean ones, and hard:
    those among all of theirs that the first machine takes for toxic. Labels are never read for held-out rows, those whose
    crc32 of the id is divisible by five. Null, empty or blank texts: scored like a text without a toxic word. Null id:
    held out. Repeated rows: scored each; labels of one id that differ: the higher. Ties: a score of just 0.5 is toxic. A
    very long text: whole, in pieces. Without labels of both kinds: their share of toxic ones, 0 without any, for all.
    Other columns, whatever their names, are not read. An empty table: no rows.
    """
    docs = texts(docs, id_col, text_col)
    spark = docs.sparkSession
    known = labels.select(labels[id_col].cast("long").alias("id"), labels[label_col].cast("int").alias("y")).where("id is not null and y in (0, 1)").where(~held_out(F.col("id"))).groupBy("id").agg(F.max("y").alias("y"))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    # 2 * train_docs rows at most.
    drawn = [known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(train_docs) for y in (0, 1)]
    sample = docs.where("text is not null").join(F.broadcast(drawn[0].unionByName(drawn[1])), F.col("doc_id") == F.col("id")).select(F.xxhash64("text").alias("k"), "text", "y").dropDuplicates(["k"])
    sample = stored(sample)

    def sentences(batches):
        """The distinct words of each document's sentences."""
        for ks, data, s in pieces(batches, 64):
            ys = s.column(2).to_pylist()
            rows = []
            for k, t, y in zip(ks, data, ys, strict=True):
                found = set()
                for sentence in SENTENCE.finditer(t):
                    sym, start, end, _ = windows(sentence[0])
                    found |= {bytes(LETTERS[sym[a + 1 : b - 1]]) for a, b in zip(start.tolist(), end.tolist(), strict=True) if b - a > 4}
                rows += [(k, y, w) for w in found]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.int32(), pa.binary()))], ["k", "y", "w"])

    held = stored(sample.mapInArrow(sentences, "k long, y int, w binary"))
    n = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not n.get(0) or not n.get(1):
        share = counts.get(1, 0) / max(1, sum(counts.values()))
        return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.lit(float(share)).alias("score"), F.lit(int(share >= 0.5)).alias("predicted"))
    odds = F.log((F.col("a") + 0.5) / (n[1] + 1)) - F.log((F.col("b") + 0.5) / (n[0] + 1))
    by_word = stored(held.groupBy("w").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b")).withColumn("s", F.col("a") * odds))
    w = Window.partitionBy("k").orderBy(F.desc("s"), "w")
    likely = held.where("y = 1").join(by_word.where(odds > 1), "w").select("k", "w", "s", F.row_number().over(w).alias("nth"), F.max("s").over(Window.partitionBy("k")).alias("top")).where("nth <= 8 and s * 3 >= top")
    positive: dict[int, list[bytes]] = {}
    for r in likely.select("k", "nth", "w").orderBy("k", "nth").collect():
        positive.setdefault(r["k"], []).append(bytes(r["w"]))
    clean = by_word.where("b > 0").where(~((F.col("a") >= 3) & (odds > 0.7)))
    negative = [bytes(r["w"]) for r in clean.orderBy(F.xxhash64("w"), "w").limit(words).select("w").collect()]
    if not positive or not negative:
        share = counts.get(1, 0) / max(1, sum(counts.values()))
        return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.lit(float(share)).alias("score"), F.lit(int(share >= 0.5)).alias("predicted"))
    machine = fit(list(positive.values()), negative)

    def judged(machine: Machine):
        def run(batches):
            for b in batches:
                data = [bytes(x) for x in b.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(data, pa.binary()), pa.array(machine.values(data)[:, 0])], ["w", "f"])

        return run

    near = clean.select("w").mapInArrow(judged(machine), "w binary, f double").where(F.col("f") > FLOOR).orderBy(F.desc("f"), "w").limit(hard).collect()
    machine = fit(list(positive.values()), list(dict.fromkeys([*(bytes(r["w"]) for r in near), *negative])))

    def valued(batches):
        for _, data, s in pieces(batches):
            yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in machine.values(data).T), s.column(2)], ["f", "hits", "n", "y"])

    seen = np.array(sample.select("k", "text", "y").mapInArrow(valued, "f double, hits double, n double, y int").collect())
    y = seen[:, 3]
    machine.curve = calibrate(seen[:, :3], y, np.where(y == 1, counts[1] / n[1], counts[0] / n[0]))
    fitted = spark.sparkContext.broadcast(machine)

    def run(batches):
        for ids, data, s in pieces(batches):
            p = fitted.value.score(fitted.value.values(data))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), s.column(2), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


#: A byte for each symbol, as training keeps words.
LETTERS = np.frombuffer(b"-" + bytes(range(97, 123)) + b"2\x80\x81\x82\x83", np.uint8)
