"""Quality classifier without labels: heuristic labellers vote, expectation-maximisation estimates how far each can be
trusted, and the posterior labels of a bounded sample train a linear scorer over hashed features."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, texts, word_hashes

_SYMBOLS = b"#$%&*+<=>@[\\]^_`{|}~/"
_UPPER, _LOWER, _DIGIT = (bytes(range(a, b)) for a, b in ((65, 91), (97, 123), (48, 58)))
_STRETCH = re.compile(rb"(?<![^\x20\x09-\x0d])([^\x20\x09-\x0d]+)(?:[\x20\x09-\x0d]+\1){4,}(?![^\x20\x09-\x0d])")
#: Words ending in a sign that does not end words; words with a letter; runs of one sign.
_MARKED = re.compile(rb"[!#$%&*+/<=>@\\^_`|~](?=[\x20\x09-\x0d]|\Z)")
_SPELT = re.compile(rb"(?<![^\x20\x09-\x0d])[^A-Za-z\x80-\xff\x20\x09-\x0d]*[A-Za-z\x80-\xff]")
_DOUBLED = re.compile(rb"([!#$%&*+/<=>@\\^_`|~])\1+")
LABELLERS = ("symbols", "capitals", "pairs", "lines", "stretch", "length", "shouts", "marked", "wordless", "doubled")


def measures(t: bytes) -> tuple[float, ...]:
    """One figure of a text for each labeller; NaN where it says nothing of the text."""
    words = t.split()
    n = len(words)
    if not n:
        return (np.nan,) * len(LABELLERS)
    size = len(t)
    upper = size - len(t.translate(None, _UPPER))
    lower = size - len(t.translate(None, _LOWER))
    lines = [x for x in t.split(b"\n") if x.strip()]
    return (
        (size - len(t.translate(None, _SYMBOLS))) / n,
        upper / (upper + lower) if upper + lower >= 20 else np.nan,
        len(set(zip(words, words[1:], strict=False))) / (n - 1) if n >= 20 else np.nan,
        1 - len(set(lines)) / len(lines) if len(lines) >= 4 else np.nan,
        float(_STRETCH.search(t) is not None) if n >= 5 else np.nan,
        sum(map(len, words)) / n,
        t.count(b"!") / n,
        len(_MARKED.findall(t)) / n,
        (n - len(_SPELT.findall(t))) / n if n >= 20 else np.nan,
        len(_DOUBLED.findall(t)) / n,
    )


#: Up to the first a text is good by this labeller, from the second on bad; between them it abstains. pairs: the other way round.
BOUNDS = np.array([(0.1, 0.3), (0.15, 0.4), (-0.7, -0.4), (0.05, 0.3), (0.0, 1.0), (9.0, 14.0), (0.1, 0.4), (0.05, 0.25), (0.1, 0.3), (0.05, 0.3)])
_SIGN = np.array([1, 1, -1, 1, 1, 1, 1, 1, 1, 1])


def votes(m: np.ndarray) -> np.ndarray:
    """1 good, 0 bad, -1 abstains, for rows of measures."""
    v = m * _SIGN
    return np.where(np.isnan(v), -1, np.where(v <= BOUNDS[:, 0], 1, np.where(v >= BOUNDS[:, 1], 0, -1)))


def em(patterns: np.ndarray, n: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of "good" for each vote pattern, labellers' accuracies (labellers x 2: on bad, on good), share of good."""
    voted = patterns >= 0
    good = np.where(voted.any(1), ((patterns == 1).sum(1) + 0.5) / (voted.sum(1) + 1), 0.5)
    good = np.where((patterns == 0).any(1), np.minimum(good, 0.1), good)
    for _ in range(rounds):
        w1, w0 = n * good, n * (1 - good)
        share = np.clip((w1.sum() + 1) / (n.sum() + 2), 0.5, 0.99)
        right = np.stack([((w0[:, None] * (patterns == 0)).sum(0) + 1) / ((w0[:, None] * voted).sum(0) + 4), ((w1[:, None] * (patterns == 1)).sum(0) + 9) / ((w1[:, None] * voted).sum(0) + 10)], 1)
        right = np.clip(right, 0.02, 0.999)
        lr = np.where(patterns == 1, np.log(right[:, 1] / (1 - right[:, 0])), np.where(patterns == 0, np.log((1 - right[:, 1]) / right[:, 0]), 0.0)).sum(1)
        after = 1 / (1 + np.exp(-np.clip(lr + np.log(share / (1 - share)), -50, 50)))
        if np.abs(after - good).max() < 1e-9:
            break
        good = after
    return good, right, float(share)


def features(m: np.ndarray, words: list[np.ndarray], dims: int) -> np.ndarray:
    """Rows of hashed features: each measure's bucket of sixteen about its bounds, the number of words on a log scale, and the words themselves, a row's shares of them of length one."""
    out = np.zeros((len(m), dims), np.float32)
    rows = np.arange(len(m))
    for i, w in enumerate(words):
        if len(w):
            seen = np.bincount((w % np.uint64(dims)).astype(np.int64), minlength=dims)
            out[i] = seen / np.sqrt((seen.astype(np.float64) ** 2).sum())
    span = BOUNDS[:, 1] - BOUNDS[:, 0]
    bucket = np.where(np.isnan(m), 16, np.clip((m * _SIGN - BOUNDS[:, 0]) / span * 8 + 4, 0, 15).astype(np.float64))
    for j in range(m.shape[1]):
        out[rows, ((j + 1) * 2654435761 + bucket[:, j].astype(np.int64) * 40503) % dims] += 1
    out[rows, (99 * 2654435761 + np.log2(1 + np.array([len(w) for w in words])).astype(np.int64) * 40503) % dims] += 0.25
    return out


def fit_linear(x: np.ndarray, y: np.ndarray, rounds: int = 12, ridge: float = 0.1) -> np.ndarray:
    """Weights and bias (last) of a logistic scorer for soft labels, by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)]).astype(np.float64)
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = np.maximum(p * (1 - p), 1e-6)
        w = w - np.linalg.solve((x * slope[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (p - y) + ridge * w)
    return w


def _measured(data: list[bytes | None]) -> np.ndarray:
    return np.array([measures(t or b"") for t in data], np.float64).reshape(-1, len(LABELLERS))


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = 4096, dims: int = 1024, reject: float = 0.5) -> DataFrame:
    """Score every text. One row per input row: doc_id, votes array<int> as in LABELLERS, score (1: surely good), keep.

    train_rows: most rows the scorer is trained on, those of the smallest hash; the labellers' accuracies come from the
    votes on all texts. A text under `reject` is not kept. Null, empty or blank text: no votes, score 0, not kept. Null
    doc_id: kept in the result and scored. Repeated rows: scored each. Ties: a score of just `reject` is kept. A very long
    text: measured whole where it is read. Other columns, whatever their names, are not read. An empty table: no rows.
    """
    docs = texts(docs, id_col, text_col)
    k = len(LABELLERS)
    code = lambda m: ((votes(m) + 1) * 3 ** np.arange(k)).sum(1).astype(np.int64) if len(m) else np.empty(0, np.int64)

    def voted(batches):
        for _, data, _ in pieces(batches):
            seen, n = np.unique(code(_measured([t for t in data if t and not t.isspace()])), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(n)], ["code", "n"])

    # At most 3 ** len(LABELLERS) rows.
    counted = docs.mapInArrow(voted, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).orderBy("code").collect()
    codes, n = (np.array([r[c] for r in counted], np.int64) for c in ("code", "n"))
    good, _, _ = em(codes[:, None] // 3 ** np.arange(k) % 3 - 1, n.astype(np.float64)) if counted else (np.empty(0), None, 1.0)

    # Of the rows whose hash lies below a bound that four times as many rows pass as are wanted, those of the smallest.
    hash_ = F.xxhash64("doc_id", "text")
    bound = int(min(1.0, 4 * train_rows / max(1, int(n.sum()))) * 2**64 - 2**63) - 1
    drawn = docs.where("text is not null").withColumn("h", hash_).where(F.col("h") <= bound).orderBy("h", "doc_id").limit(train_rows)

    def sampled(batches):
        for _, data, _ in pieces(batches):
            m, words = _measured(data), word_hashes(data, True)
            at = [i for i, w in enumerate(words) if len(w)]
            x = features(m, words, dims)[at]
            yield pa.RecordBatch.from_arrays([pa.array(code(m)[at], pa.int64()), pa.array([r.astype(np.float16).tobytes() for r in x], pa.binary())], ["code", "x"])

    sample = drawn.select("doc_id", "text").mapInArrow(sampled, "code long, x binary").collect()
    x = np.stack([np.frombuffer(r["x"], np.float16) for r in sample]).astype(np.float32) if sample else np.empty((0, dims), np.float32)
    w = fit_linear(x, good[np.searchsorted(codes, [r["code"] for r in sample])] if sample else np.empty(0))

    def run(batches):
        for ids, data, _ in pieces(batches):
            m, words = _measured(data), word_hashes(data, True)
            s = 1 / (1 + np.exp(-np.clip(features(m, words, dims) @ w[:-1] + w[-1], -30, 30)))
            s = np.where([len(x) > 0 for x in words], s, 0.0)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(votes(m).tolist(), pa.list_(pa.int32())), pa.array(s), pa.array(s >= reject)], ["doc_id", "votes", "score", "keep"])

    return docs.mapInArrow(run, "doc_id long, votes array<int>, score double, keep boolean")
