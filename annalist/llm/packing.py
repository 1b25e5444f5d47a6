"""Sum-of-squares online packing of documents into fixed windows.

Every task packs the documents it reads, one after another, without a shuffle: a document's whole windows
leave at once, its remainder goes to the fill level that keeps the sum of squared level counts smallest.
"""

from __future__ import annotations

import json
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, texts

_SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
_tokenizers: dict[str, tuple] = {}
#: How byte-level vocabularies write bytes as characters: printable Latin-1 as itself, the rest from U+0100 on.
_SELF = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTES = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _SELF)}


#: Longer words, in bytes, are rarely met again and not remembered; so a worker holds known_words of this length at most.
KEPT_WORD = 64


class _Words(dict):
    """Words' ids as bytes, worked out when first asked for."""

    def __init__(self, tok, cut) -> None:
        self.tok, self.cut, self.parts, self.tokenize = tok, cut, {}, tok.model.tokenize

    def part(self, part: str) -> bytes:
        if (got := self.parts.get(part)) is None:
            mapped = part if part.isascii() and part.isalpha() else part.encode().decode("latin-1").translate(_BYTES)
            got = array("I", [t.id for t in self.tokenize(mapped)]).tobytes()
            if len(part) <= KEPT_WORD:
                self.parts[part] = got
        return got

    def __missing__(self, word: bytes) -> bytes:
        w = word.decode()
        if not (w.isascii() or max(w) < "\u0250" and "\u0130" not in w) or not w.isprintable() or "<|" in w:
            got = array("I", self.tok.encode(w, add_special_tokens=False).ids).tobytes()
        elif (low := w.lower()).isalpha():
            got = self.part(low)
        else:
            got = b"".join([self.part(p) for p in self.cut.findall(low)])
        if len(word) <= KEPT_WORD:
            self[word] = got
        return got


def _encoder(path: str, known_words: int):
    """A function from texts (UTF-8) to id arrays. The vocabulary drops white space and never joins across it, so each
    distinct word is encoded once and remembered (known_words at most) by the worker process. Words of printable
    characters below U+0250, whose lower case is one character each and which normalisation leaves alone, are cut by the
    vocabulary's own pattern and go straight to its merges; any other word goes through the whole tokenizer."""
    if path not in _tokenizers:
        import regex
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        cut = json.loads(tok.to_str())["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        _tokenizers[path] = (tok, _Words(tok, regex.compile(cut)))
    tok, known = _tokenizers[path]

    def encode(items: list[bytes | None]) -> list[np.ndarray]:
        # ASCII letters may be lowered first, unless a special token's characters could come of it.
        out = []
        for t in items:
            for held in (known, known.parts):
                if len(held) > known_words:
                    held.clear()
            out.append(np.frombuffer(b"".join([known[w] for w in (t if b"<|" in t else t.lower()).split()]) if t else b"", np.uint32))
        return out

    return encode


class Packer:
    """Windows of `size` ids with a level array: counts[h] is the number of open windows filled to h.

    A piece of s ids goes to the level h (0: a new window) that leaves the least sum of squared counts: one window goes
    from h to h + s. Past the end of a window the piece is cut, and what is left over opens a window of its own, which
    costs `cut` besides. So a level's count stays under about `cut` / 2 whatever the lengths of documents, and the number of open
    windows has a bound. Of equal levels, the fullest.
    """

    def __init__(self, size: int, first: int, cut: int = 16) -> None:
        self.size, self.next, self.cut = size, first, cut
        self.counts = np.zeros(size, np.int64)
        self.open: dict[int, list[list]] = {}  # fill level -> open windows, each a list of (doc, start, ids, doc_tokens)
        self.done: list[tuple] = []

    def _close(self, window: list) -> None:
        at = 0
        for doc, start, ids, total in window:
            self.done.append((doc, start, ids, total, self.next, at))
            at += len(ids)
        self.next += 1

    def _take(self, h: int) -> list:
        self.counts[h] -= 1
        return self.open[h].pop()

    def _put(self, h: int, window: list) -> None:
        self.counts[h] += 1
        self.open.setdefault(h, []).append(window)

    def _level(self, s: int, cut: int, new: bool) -> int:
        """The level for a piece of s ids, under a whole window."""
        h = np.flatnonzero(self.counts)
        after = (h + s) % self.size
        # Sums of squares change by 1 - 2 counts[h] where a window leaves and by 1 + 2 counts[h] where one enters; a full one enters nowhere.
        cost = 1 - 2 * self.counts[h] + np.where(after > 0, 1 + 2 * self.counts[after], 0) + np.where(h + s > self.size, cut, 0)
        if not len(h) or new and 1 + 2 * self.counts[s] < cost.min():
            return 0
        return int(h[len(h) - 1 - np.argmin(cost[::-1])])

    def _place(self, piece: tuple, cut: int, new: bool) -> None:
        doc, start, ids, total = piece
        h = self._level(len(ids), cut, new)
        window, room = self._take(h) if h else [], self.size - h
        window.append((doc, start, ids[:room], total))
        if len(ids) < room:
            self._put(h + len(ids), window)
            return
        self._close(window)
        if len(ids) > room:
            rest = (doc, start + room, ids[room:], total)
            if new:
                self._put(len(ids) - room, [rest])
            else:
                self._place(rest, cut, new)

    def add(self, doc, ids: np.ndarray) -> None:
        total, size = len(ids), self.size
        whole = total - total % size
        for at in range(0, whole, size):
            self._close([(doc, at, ids[at : at + size], total)])
        if total > whole:
            self._place((doc, whole, ids[whole:], total), self.cut, True)

    def finish(self) -> None:
        """No more documents: the emptiest windows' pieces go to the others by the same rule, cuts free, until one is left, which is split into windows of powers of two."""
        while self.counts.sum() > 1:
            for piece in self._take(int(np.flatnonzero(self.counts)[0])):
                self._place(piece, 0, False)
        for h in np.flatnonzero(self.counts).tolist():
            window, left = self._take(h), h
            while left:
                room = 1 << (left.bit_length() - 1)
                left -= room
                part = []
                while room:
                    doc, start, ids, total = window.pop(0)
                    part.append((doc, start, ids[:room], total))
                    if len(ids) > room:
                        window.insert(0, (doc, start + room, ids[room:], total))
                    room -= min(room, len(ids))
                self._close(part)


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = 2048, end_id: int = 1, known_words: int = 600_000) -> DataFrame:
    """Pack every document into sequences of at most `window` ids.

    tokenizer: file of a public vocabulary, readable on the executors, that drops white space. Each document is its
    ids and end_id. One row per piece: doc_id, start (ids of the document before it), length, ids (little-endian
    unsigned 32-bit), doc_tokens, sequence_id, offset. Sequences are full, or of a power of two in length, so nothing is
    padding; sequence ids are unique, the reading task's number times 2**40 and a running number.

    Null or empty text: end_id alone. Null doc_id: packed, with a null id. Repeated rows: packed each time. A very long
    text: cut into windows; a task holds one text's ids and the open windows, whose number the rule bounds. Ties: of equal levels the
    fullest. Other columns, whatever their names, are not read. An empty table: no rows.
    """

    def run(batches):
        encode = _encoder(tokenizer, known_words)
        packer = Packer(window, TaskContext.get().partitionId() << 40)

        def rows():
            done, packer.done = packer.done, []
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in done], pa.int64()), pa.array([r[1] for r in done], pa.int64()), pa.array([len(r[2]) for r in done], pa.int64()),
                    pa.array([r[2].tobytes() for r in done], pa.binary()), pa.array([r[3] for r in done], pa.int64()), pa.array([r[4] for r in done], pa.int64()), pa.array([r[5] for r in done], pa.int64()),
                ],
                ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
            )

        for ids, data, _ in pieces(batches):
            for doc, got in zip(ids, encode(data), strict=True):
                packer.add(doc, np.append(got, np.uint32(end_id)))
            yield rows()
        packer.finish()
        yield rows()

    return texts(docs, id_col, text_col).mapInArrow(run, _SCHEMA)


def digests(packed: DataFrame) -> DataFrame:
    """The pieces with a checksum in place of their ids."""
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
