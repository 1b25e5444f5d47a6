"""Removal of repeated word runs over prefix-partitioned groups of suffixes.

A suffix is one word position of one document. Suffixes go to groups by a prefix of variable length: the shortest one
that is not too common, so that a group holds about as many as fit in memory. Two suffixes meet in an internal node of
depth n_words or more of their group's suffix tree exactly when their first n_words words agree. Only these nodes are
wanted, so in place of the tree a group holds a hash of each suffix's first n_words words and sorts by it: runs of equal
hashes are the nodes, and what lies below them is never compared. No maximal repeats longer than that come out as such;
neighbouring windows join to ranges instead. Shipping the words of every suffix, as the whole tree needs, would take over
eight times the input. Suffixes whose longest prefix is still too common are reduced by Spark's own partial aggregation.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, bitmap, gram_hashes, in_bitmap, longs, mix, pieces, stored, texts, word_hashes

#: Prefix lengths tried, in words, and cells that count each.
PREFIXES = (1, 2, 4, 8)
CELLS = 1 << 14
#: Suffixes that a group should hold.
GROUP = 1_000_000


def _suffixes(words: np.ndarray, n: int, lengths: tuple[int, ...]):
    """Hash of each suffix's first n words, and of its prefixes."""
    full = gram_hashes(words, n)
    return full, [gram_hashes(words, k)[: len(full)] for k in lengths]


def _packed(a: np.ndarray) -> np.ndarray:
    """Bytes by place value, so that small numbers compress."""
    return a.view(np.uint8).reshape(len(a), a.itemsize).T.copy()


def _unpacked(data: bytes, n: int, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.frombuffer(data, np.uint8).reshape(size, n).T.copy().view(kind).ravel()


def repeated_ranges(docs: DataFrame, n_words: int = 13, group: int = GROUP, cells: int = CELLS, prefixes: tuple[int, ...] = PREFIXES) -> DataFrame:
    """(doc_id, runs): the word ranges (pairs of little-endian 32-bit start and end) covered by suffixes whose first n_words
    words also start in a document with a smaller doc_id.

    docs: (doc_id, text). A document may come in several rows. Null doc_id: left out.
    Suffixes are told apart by 64-bit hashes of their words within a group.
    """
    spark = docs.sparkSession
    lengths = tuple(k for k in prefixes if k < n_words)

    def count(batches):
        seen = np.zeros((len(lengths), cells), np.int64)
        for _, data, _ in pieces(batches):
            for w in word_hashes(data):
                for level, h in enumerate(_suffixes(w, n_words, lengths)[1]):
                    seen[level] += np.bincount((h % np.uint64(cells)).astype(np.int64), minlength=cells)
        cell = np.flatnonzero(seen.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(seen.ravel()[cell])], ["cell", "n"])

    docs = docs.where("doc_id is not null")
    # At most len(prefixes) * cells rows, whatever the input.
    counts = docs.mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    table = np.zeros((len(lengths), cells), np.int64)
    for r in counts:
        table[divmod(r["cell"], cells)] = r["n"]
    total = int(table[0].sum())
    n_groups = max(1, -(-total // group))
    common = table > group  # suffixes of a cell that holds more go on to a longer prefix, and at last to Spark's own aggregation

    def split(batches):
        """Rows (group, n, blob) of suffixes in sorted order; group -1 - k: the suffixes whose prefixes are all common, dealt out by hash."""
        press = zstandard.ZstdCompressor(level=1)
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def flush():
            full, to, doc, pos = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.lexsort((full, to))
            full, to, doc, pos = full[order], to[order], doc[order], pos[order]
            cuts = np.flatnonzero(np.diff(to)) + 1
            rows = []
            for a, b in zip([0, *cuts], [*cuts, len(to)], strict=True):
                f, base = full[a:b], doc[a:b].min()
                blob = b"".join(x.tobytes() for x in (_packed(np.diff(f, prepend=np.uint64(0))), _packed(doc[a:b] - base), _packed(pos[a:b])))
                rows.append((int(to[a]), b - a, int(base), press.compress(blob)))
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["g", "n", "base", "blob"])

        for ids, data, _ in pieces(batches):
            for doc, w in zip(ids, word_hashes(data), strict=True):
                full, heads = _suffixes(w, n_words, lengths)
                if not len(full):
                    continue
                to = np.full(len(full), -1, np.int64)
                for level in range(len(lengths) - 1, -1, -1):
                    h = heads[level]
                    to = np.where(common[level][(h % np.uint64(cells)).astype(np.int64)], to, (mix(h + np.uint64(level)) % np.uint64(n_groups)).astype(np.int64))
                held.append((full, to, np.full(len(full), doc, np.int64), np.arange(len(full), dtype=np.int32)))
                size += len(full)
                if size >= GROUP // 2:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    def opened(g: pd.DataFrame):
        full, doc, pos = [], [], []
        for n, base, blob in zip(g["n"], g["base"], g["blob"], strict=True):
            data = zstandard.ZstdDecompressor().decompress(blob)
            full.append(np.cumsum(_unpacked(data[: 8 * n], n, np.uint64), dtype=np.uint64))
            doc.append(_unpacked(data[8 * n : 16 * n], n, np.int64) + base)
            pos.append(_unpacked(data[16 * n :], n, np.int32))
        return np.concatenate(full), np.concatenate(doc), np.concatenate(pos)

    n_buckets = max(1, total // (4 * group))

    def by_bucket(doc: np.ndarray, pos: np.ndarray) -> pd.DataFrame:
        """Marks for the task that will hold all of a document's: one row per bucket of documents."""
        to = (mix(doc.view(np.uint64)) % np.uint64(n_buckets)).astype(np.int64)
        order = np.lexsort((pos, doc, to))
        doc, pos, to = doc[order], pos[order], to[order]
        press, rows = zstandard.ZstdCompressor(level=1), []
        cuts = np.flatnonzero(np.diff(to)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(to)], strict=True) if len(to) else ():
            blob = _packed(np.diff(doc[a:b], prepend=0)).tobytes() + _packed(pos[a:b]).tobytes()
            rows.append((int(to[a]), b - a, press.compress(blob)))
        return pd.DataFrame(rows, columns=["bucket", "n", "blob"])

    def ranges(doc: np.ndarray, pos: np.ndarray) -> pd.DataFrame:
        order = np.lexsort((pos, doc))
        doc, pos = doc[order], pos[order]
        first = np.flatnonzero((np.diff(doc, prepend=~doc[:1]) != 0) | (np.diff(pos, prepend=0) > n_words))
        last = np.append(first[1:], len(doc)) - 1
        run = np.stack([pos[first], pos[last] + n_words], 1).astype("<i4")
        head = np.flatnonzero(np.diff(doc[first], prepend=~doc[:1]))
        return pd.DataFrame({"doc_id": doc[first][head], "runs": [r.tobytes() for r in np.split(run, head[1:])] if len(head) else []})

    def gathered(g: pd.DataFrame) -> pd.DataFrame:
        doc, pos = [], []
        for n, blob in zip(g["n"], g["blob"], strict=True):
            data = zstandard.ZstdDecompressor().decompress(blob)
            doc.append(np.cumsum(_unpacked(data[: 8 * n], n, np.int64)))
            pos.append(_unpacked(data[8 * n :], n, np.int32))
        return ranges(np.concatenate(doc), np.concatenate(pos))

    def tree(g: pd.DataFrame) -> pd.DataFrame:
        full, doc, pos = opened(g)
        order = np.argsort(full)
        full, doc, pos = full[order], doc[order], pos[order]
        start = np.flatnonzero(np.diff(full, prepend=~full[:1]))
        size = np.diff(start, append=len(full))
        first = np.repeat(np.minimum.reduceat(doc, start), size)
        later = doc > first
        return by_bucket(doc[later], pos[later])

    def loose(batches):
        for b in batches:
            for g in b.to_pandas().itertuples():
                full, doc, pos = opened(pd.DataFrame([g]))
                yield pa.RecordBatch.from_arrays([longs(full), pa.array(doc), pa.array(pos)], ["h", "doc_id", "pos"])

    def gather(marks: DataFrame) -> DataFrame:
        return marks.groupBy("bucket").applyInPandas(gathered, "doc_id long, runs binary")

    blobs = docs.mapInArrow(split, "g long, n long, base long, blob binary")
    marks_type = "bucket long, n long, blob binary"
    if not common[-1].any():
        return gather(blobs.groupBy("g").applyInPandas(tree, marks_type))
    blobs = stored(blobs)
    rest = blobs.where("g < 0").mapInArrow(loose, "h long, doc_id long, pos int")
    first = rest.groupBy("h").agg(F.min("doc_id").alias("first"))
    late = rest.join(first, "h").where("doc_id > first").select("doc_id", "pos")

    def rows(batches):
        for b in batches:
            yield pa.RecordBatch.from_pandas(by_bucket(b.column(0).to_numpy(), b.column(1).to_numpy()), preserve_index=False)

    return gather(blobs.where("g >= 0").groupBy("g").applyInPandas(tree, marks_type).unionByName(late.mapInArrow(rows, marks_type)))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_words: int = 13, bits: int = 1 << 26, **how) -> DataFrame:
    """Remove each word covered by a window of n_words words that also starts in a document with a smaller id.

    Windows are judged on the input texts. One row per input row: doc_id, n_words, n_removed, kept_text (the kept words,
    joined by a space). Null or empty text: no words. Null doc_id: kept whole, and no document is smaller for its sake.
    Texts under n_words words: kept whole. Repeated rows: of the same id, so neither removes words of the other. Ties: of windows equal across documents that
    of the smallest id stays, whatever its place. Other columns, whatever their names, are not read. Rows
    that share an id but not a text: word positions repeated in one of the texts go from all. A very long text is hashed in
    pieces; its suffixes are dealt out like any. An empty table: no rows.
    bits: size of the bitmap of documents with repeats, which only decides how many others are dealt out with them.
    """
    docs = texts(docs, id_col, text_col)
    marks = stored(repeated_ranges(docs, n_words, **how))
    sieve = docs.sparkSession.sparkContext.broadcast(bitmap(marks, "doc_id", bits))

    def cut(batches):
        for ids, data, s in pieces(batches):
            out = []
            for t, marked in zip(data, s.column(2).to_pylist() if s.num_columns > 2 else [None] * len(ids), strict=True):
                words = t.split() if t else []
                n = len(words)
                if marked:
                    kept, at = [], 0
                    for a, b in np.frombuffer(marked, "<i4").reshape(-1, 2).tolist():
                        kept += words[at:a]
                        at = b
                    words = kept + words[at:]
                out.append((n, n - len(words), b" ".join(words).decode()))
            n, gone, kept = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"])

    def sifted(batches, marked: bool):
        for b in batches:
            ids = b.column(0)
            may = in_bitmap(sieve.value, bits, ids.fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64)) & ids.is_valid().to_numpy(zero_copy_only=False)
            yield b.filter(pa.array(may == marked))

    out = "doc_id long, n_words long, n_removed long, kept_text string"
    # Only documents that may have marks are dealt out to meet them.
    cutting = docs.mapInArrow(lambda b: sifted(b, True), "doc_id long, text string").join(marks.hint("merge"), "doc_id", "left").select("doc_id", "text", "runs")
    return cutting.mapInArrow(cut, out).unionByName(docs.mapInArrow(lambda b: cut(sifted(b, False)), out))


assert SPACES == b" \t\n\x0b\x0c\r"  # what bytes.split() splits on
