"""Personal data by patterns and a skip-chain conditional random field.

Four patterns give the base spans. Base spans and other words that hold a digit or an at sign are the field's nodes. A
node's potential comes from its form; neighbours share potentials, and so do nodes of one key, however distant: names alike
up to the at sign, numbers alike in their last digits. All weights are fitted to the base labels of the whole corpus by
pseudo-likelihood. Base spans are evidence, and loopy message passing carries it to the words whose label no pattern shows:
a repetition of what is known in another form is found. Words so labelled are added.
"""

from __future__ import annotations

import bisect
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_PATTERN, pieces, texts

KINDS = ("email", "ip", "card", "phone")
#: From the at sign on; what stands before it is looked up to the left, which a long word without one would make slow.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
#: Runs of digits are taken whole from their start, so that a long one is read once.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(WORD_PATTERN)
_LABELS = len(KINDS) + 1
#: Features of a word's form: at sign, dots, digits, letters, plus sign, marks between digits.
_SIZES = (2, 5, 7, 2, 2, 2)
_FORMS = 2 * 5 * 7 * 2 * 2 * 2
_AROUND = ",;:!?\"'[]{}<>|*#$%&"
_DIGITS = (0, 3, 6, 9, 13, 19)


def _luhn(digits: str) -> bool:
    odd, even = digits[::-1][::2], digits[::-1][1::2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' matches that hold, in order."""
    out = []
    if "@" in text:
        after = 0
        for m in _DOMAIN.finditer(text):
            a = m.start()
            while a > after and text[a - 1] in _LOCAL:
                a -= 1
            if a < m.start():
                out.append((a, 0, m.end()))
                after = m.end()
    if "." in text:
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(d := p.lstrip("0")) <= 3 and int(d or "0") <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if 14 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and _luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= sum(map(str.isdigit, m[0])) <= 15]
    return sorted(out)


def _form(w: str) -> tuple[int, ...]:
    """A word's form: numbers of the features it has, one of each of six kinds."""
    digits = sum("0" <= c <= "9" for c in w)
    has = ("@" in w, min(4, w.count(".")), bisect.bisect_left(_DIGITS, digits), any(c.isalpha() for c in w), "+" in w, "-" in w or "(" in w or " " in w)
    return tuple(int(x) for x in has)


def _code(form: tuple[int, ...]) -> int:
    code = 0
    for x, size in zip(form, _SIZES, strict=True):
        code = code * size + x
    return code


def _key(w: str) -> str:
    """What makes words similar: the part of a name before its at sign, or the last seven digits of a number; empty for short ones."""
    if "@" in w or any(c.isalpha() for c in w):
        name = w.strip("@").partition("@")[0].lower()
        return name if len(name) >= 5 else ""
    digits = "".join(c for c in w if "0" <= c <= "9")
    return digits[-7:] if len(digits) >= 7 else ""


def nodes(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, str, int, int, int]]:
    """(start, end, code of the form, key, label, first and last word) of the base spans, whose label is known, and of other words with a digit or an at sign, whose label is 0. Punctuation around a word doesn't belong to it."""
    out, at, n = [], 0, -1
    words = []
    for n, m in enumerate(_WORD.finditer(text)):
        words.append(m.start())
        w = m[0]
        if not ("@" in w or any("0" <= c <= "9" for c in w)):
            continue
        a = m.start() + len(w) - len(w.lstrip(_AROUND))
        w = w.strip(_AROUND).rstrip(".")
        while at < len(base) and base[at][2] <= a:
            at += 1
        # Base spans are sorted by start; one further back may still reach into the word.
        if w and not any(s < a + len(w) and e > a for s, _, e in base[max(0, at - len(KINDS)) : at + len(KINDS) + 1]):
            out.append((a, a + len(w), _code(_form(w)), _key(w), 0, n, n))
    for a, k, e in base:
        w = text[a:e]
        out.append((a, e, _code(_form(w)), _key(w), k + 1, bisect.bisect_right(words, a) - 1, bisect.bisect_right(words, e - 1) - 1))
    return sorted(out)


def edges(found: list[tuple], skip: bool = True) -> list[tuple[int, int, int]]:
    """(node, node, type): 0 between neighbours, 1 from a node to the next of the same key, however far."""
    out, last = [], {}
    for i, x in enumerate(found):
        if i and found[i - 1][6] == x[5] - 1:
            out.append((i - 1, i, 0))
        if skip and (key := x[3]):
            if key in last:
                out.append((last[key], i, 1))
            last[key] = i
    return out


def _observed(found: list[tuple]) -> list[int]:
    """Cells (form, labels of the neighbours to the left and right and of the same key before and after, label) of a document's nodes.

    A word of the same key as a base span may well be personal data that no pattern shows: its label counts as not seen.
    """
    known = {x[3] for x in found if x[4] and x[3]}
    seen = [_LABELS if not x[4] and x[3] in known else x[4] for x in found]
    around = [[_LABELS] * 4 for _ in found]
    for i, j, kind in edges(found):
        around[i][2 * kind + 1], around[j][2 * kind] = seen[j], seen[i]
    out = []
    for x, y, near in zip(found, seen, around, strict=True):
        if y < _LABELS:
            cell = x[2]
            for z in near:
                cell = cell * (_LABELS + 1) + z
            out.append(cell * _LABELS + y)
    return out


def fit(cells: np.ndarray, n: np.ndarray, rounds: int = 400, ridge: float = 1e-4, step: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Potentials of forms (codes x labels) and of the two edge types (2 x labels x labels) that make the labels seen most likely given those around them.

    Pseudo-likelihood, half of it with a node's form unseen, so that what neighbours and repetitions say is learned where
    the form would have said it all. Cells count by their share, so a corpus of any size is fitted alike. Ascent by
    steps of a size for each weight (Adam).
    """
    total = sum(_SIZES)
    if not len(cells):
        return np.zeros((_FORMS, _LABELS)), np.zeros((2, _LABELS, _LABELS))
    rest, y = np.divmod(cells, _LABELS)
    near = np.empty((len(cells), 4), np.int64)
    for k in (3, 2, 1, 0):
        rest, near[:, k] = np.divmod(rest, _LABELS + 1)
    on = np.zeros((len(cells), total))
    at = total
    for size in reversed(_SIZES):
        at -= size
        rest, x = np.divmod(rest, size)
        on[np.arange(len(cells)), at + x] = 1
    hot = np.zeros((4, len(cells), _LABELS))  # neighbours' labels; none: all zero
    for k in range(4):
        some = np.flatnonzero(near[:, k] < _LABELS)
        hot[k, some, near[some, k]] = 1
    both = np.stack([hot[0] + hot[1], hot[2] + hot[3]])
    share, goal = n / n.sum() / 2, np.eye(_LABELS)[y]
    w, pair = np.zeros((total, _LABELS)), np.zeros((2, _LABELS, _LABELS))
    moments = [[np.zeros_like(v), np.zeros_like(v)] for v in (w, pair)]
    for t in range(1, rounds + 1):
        beside = both[0] @ pair[0] + both[1] @ pair[1]
        g_w, g_pair = -ridge * w, -ridge * pair
        for score, own in ((beside + on @ w, True), (beside, False)):
            p = np.exp(score - score.max(1, keepdims=True))
            miss = share[:, None] * (goal - p / p.sum(1, keepdims=True))
            if own:
                g_w = g_w + on.T @ miss
            g = np.stack([both[0].T @ miss, both[1].T @ miss])
            g_pair = g_pair + g + g.transpose(0, 2, 1)
        for v, g, (m1, m2) in zip((w, pair), (g_w, g_pair), moments, strict=True):
            m1 += 0.1 * (g - m1)
            m2 += 0.001 * (g * g - m2)
            v += step * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-9)
    forms = np.array(np.unravel_index(np.arange(_FORMS), _SIZES)).T + np.cumsum([0, *_SIZES[:-1]])
    return w[forms].sum(1), pair


def train(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """fit() on all of (doc_id, text). What reaches the driver has a bound that the numbers of forms and labels set."""

    def count(batches):
        for _, data, _ in pieces(batches):
            seen: list[int] = []
            for t in data:
                if t and _CANDIDATE.search(t):
                    s = t.decode()
                    seen += _observed(nodes(s, base_spans(s)))
            cell, n = np.unique(np.array(seen, np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(n)], ["cell", "n"])

    rows = docs.mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).orderBy("cell").collect()
    return fit(np.array([r["cell"] for r in rows], np.int64), np.array([r["n"] for r in rows], np.float64))


_CANDIDATE = re.compile(rb"[0-9@]")


def marginals(node: np.ndarray, links: np.ndarray, pair: np.ndarray, rounds: int) -> np.ndarray:
    """Loopy belief propagation over many documents at once, as one graph of separate parts."""
    if not len(links):
        scores = node
    else:
        a, b = np.concatenate([links[:, 0], links[:, 1]]), np.concatenate([links[:, 1], links[:, 0]])
        back = np.concatenate([np.arange(len(links)) + len(links), np.arange(len(links))])
        weight = np.concatenate([pair[links[:, 2]], pair[links[:, 2]].transpose(0, 2, 1)])
        message = np.zeros((len(a), node.shape[1]))
        for _ in range(rounds):
            scores = node.copy()
            np.add.at(scores, b, message)
            out = scores[a] - message[back]
            new = np.logaddexp.reduce(out[:, :, None] + weight, axis=1)
            new -= np.logaddexp.reduce(new, axis=1, keepdims=True)
            message = 0.5 * message + 0.5 * new
        scores = node.copy()
        np.add.at(scores, b, message)
    return np.exp(scores - np.logaddexp.reduce(scores, axis=1, keepdims=True))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = 12, sure: float = 0.5, skip: bool = True, potentials: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """Personal data in every text: base spans by pattern, and words that the field labels with probability `sure` or more.

    One row per input row: doc_id, spans array<struct<kind, start, end, base>> by start, then kind as listed; code
    points, end exclusive. potentials: of train(), from these documents if not given; skip: whether words of one key, however
    distant, are joined. Null or empty text: no spans. Null doc_id: kept. Repeated rows: the same spans each. Ties: of
    equally likely kinds the first listed. A very long text: its candidate words and their edges, of which there are at
    most two a word, are held by one task. Other columns, whatever their names, are not read. An empty table: no rows.
    """
    docs = texts(docs, id_col, text_col)
    node_w, pair_w = potentials or train(docs)
    spans_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))

    def run(batches):
        for ids, data, _ in pieces(batches):
            spans: list[list] = []
            held: list[tuple] = []
            links: list[tuple[int, int, int]] = []
            for d, t in enumerate(data):
                base = base_spans(s := t.decode()) if t and _CANDIDATE.search(t) else []
                spans.append([(a, k, e, True) for a, k, e in base])
                if t and _CANDIDATE.search(t):
                    mine = nodes(s, base)
                    links += [(i + len(held), j + len(held), k) for i, j, k in edges(mine, skip)]
                    held += [(d, *x) for x in mine]
            if held:
                known = np.array([x[5] for x in held])
                scores = node_w[[x[3] for x in held]]
                # What the patterns say is evidence: a base span has its label and no other.
                scores = np.where((known > 0)[:, None], np.where(np.arange(_LABELS) == known[:, None], 0.0, -1e3), scores)
                p = marginals(scores, np.array(links, np.int64).reshape(-1, 3), pair_w, rounds)
                best = p[:, 1:].argmax(1)
                for i in np.flatnonzero((1 - p[:, 0] >= sure) & (known == 0)):
                    d, a, e = held[i][0], held[i][1], held[i][2]
                    spans[d].append((a, int(best[i]), e, False))
            rows = [[{"kind": KINDS[k], "start": a, "end": e, "base": base} for a, k, e, base in sorted(s)] for s in spans]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(rows, spans_type)], ["doc_id", "spans"])

    return docs.mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,end:long,base:boolean>>")


def digests(found: DataFrame) -> DataFrame:
    """Counts and digests: n_<kind> and base_sha256 of the base spans, spans as text."""
    joined = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("spans", lambda x: x["base"])
    count = lambda k: F.size(F.filter("spans", lambda x: x["base"] & (x["kind"] == k))).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
