"""Helpers shared by the training-data operators."""

from __future__ import annotations

import functools
import gc
import hashlib
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of bytes other than these, in every operator.
SPACES = b" \t\n\x0b\x0c\r"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share; where that is unset, in the temporary folder of a local session, never of a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{base or tempfile.gettempdir() + '/checkpoints'}/{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str | None = None, **options: str) -> DataFrame:
    """df, written to the shared folder as Parquet and read back: its lineage ends there, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = path or shared_dir(spark)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def released(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files of jobs whose results are stored: it does so once the plans that nobody holds any more are collected, here and in the driver's JVM."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def texts(docs: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """The two columns every operator reads, as doc_id long and text string; other columns, whatever their names, are left out."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"), *[docs[c] for c in more])


def bitmap(keys: DataFrame, key: str, bits: int) -> np.ndarray:
    """A membership bitmap of a fixed size (bits / 8 bytes, whatever the input) over hash values in a long column; false positives only."""
    rows = (
        keys.select(F.pmod(F.col(key), F.lit(bits)).alias("b"))
        .groupBy(F.expr("bitmap_bucket_number(b + 1)").alias("bucket"))
        .agg(F.expr("bitmap_construct_agg(bitmap_bit_position(b + 1))").alias("bitmap"))
        .collect()
    )
    out = np.zeros(max(bits, 32768) // 8, np.uint8)
    for r in rows:
        at = (r["bucket"] - 1) * 4096
        out[at : at + 4096] = np.frombuffer(bytes(r["bitmap"]), np.uint8)
    return out


def in_bitmap(table: np.ndarray, bits: int, keys: np.ndarray) -> np.ndarray:
    """Whether each key (uint64, read as a signed long) may be among the keys of bitmap()."""
    b = np.mod(keys.view(np.int64), bits)
    return (table[b >> 3] >> (b & 7).astype(np.uint8)) & 1 == 1


# --- word hashes -----------------------------------------------------------------------------

#: Bytes hashed at a time; what that takes in memory is some forty times as much.
CHUNK = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_LOOK = np.frombuffer(hashlib.shake_256(b"byte values").digest(2048), np.uint64) | np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[list(SPACES)] = True
NONE = np.empty(0, np.uint64)


@functools.cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 2**64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the splitmix finaliser)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _sums(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unmixed hash, start and end of each word of at most 2 * CHUNK bytes: a polynomial hash by one running sum over the bytes."""
    a = np.frombuffer(data, np.uint8)
    if not len(a):
        return NONE, np.empty(0, np.int64), np.empty(0, np.int64)
    up, down = _powers(CHUNK * 2 + 2)
    edge = np.flatnonzero(np.diff(_SPACE[a], prepend=True, append=True))
    start, end = edge[::2], edge[1::2]
    total = np.zeros(len(a) + 1, np.uint64)
    np.cumsum(_LOOK[a] * up[: len(a)], out=total[1:])
    return (total[end] - total[start]) * down[start], start, end


def _hashed(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word of at most 2 * CHUNK bytes."""
    h, start, _ = _sums(data)
    return mix(h), start


def _parts(data: bytes):
    """Pieces of about CHUNK bytes of one long text, cut at white space."""
    at = 0
    while len(data) - at > CHUNK:
        cut = max(data.rfind(bytes([c]), at, at + CHUNK) for c in SPACES)
        if cut <= at:
            cut = min((p for c in SPACES if (p := data.find(bytes([c]), at + CHUNK)) >= 0), default=len(data))
        yield data[at:cut]
        at = cut
    yield data[at:]


def _long(data: bytes, lower: bool) -> np.ndarray:
    """The words' hashes of a text of any length, CHUNK bytes at a time; a word that is cut goes on with what it has so far."""
    out, held, size = [], 0, 0
    for at in range(0, len(data), CHUNK):
        part = data[at : at + CHUNK]
        h, start, end = _sums(part.lower() if lower else part)
        if size and (not len(start) or start[0] > 0):  # the word that was cut ended with the piece
            out.append(np.array([held], np.uint64))
            held = size = 0
        if size:
            h[0] = np.uint64((held + int(h[0]) * pow(_BASE, size, 2**64)) % 2**64)
        if len(end) and end[-1] == len(part):
            whole = len(end) == 1 and start[0] == 0
            held, size = int(h[-1]), len(part) + size if whole else len(part) - int(start[-1])
            h = h[:-1]
        else:
            held = size = 0
        out.append(h)
    if size:
        out.append(np.array([held], np.uint64))
    return mix(np.concatenate(out))


def word_hashes(data: list[bytes | None], lower: bool = False) -> list[np.ndarray]:
    """For each text its words' 64-bit hashes, in order. Null: none. Texts are hashed CHUNK bytes at a time, within words too, so beside the texts and their words' hashes memory is bounded."""
    out: list[np.ndarray] = [NONE] * len(data)
    group: list[int] = []
    size = 0

    def flush() -> None:
        h, start = _hashed(b" ".join(data[i].lower() if lower else data[i] for i in group))
        ends = np.cumsum([len(data[i]) + 1 for i in group[:-1]], dtype=np.int64)
        for i, part in zip(group, np.split(h, np.searchsorted(start, ends)), strict=True):
            out[i] = part
        group.clear()

    for i, t in enumerate(data):
        if t and len(t) > CHUNK:
            out[i] = _long(t, lower)
        elif t:
            if group and size + len(t) > CHUNK:
                flush()
                size = 0
            group.append(i)
            size += len(t) + 1
    if group:
        flush()
    return out


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n words."""
    if len(words) < n:
        return NONE
    m = len(words) - n + 1
    h = np.zeros(m, np.uint64)
    for j in range(n):
        h = h * np.uint64(0xD6E8FEB86659FD93) + words[j : j + m]
    return mix(h + np.uint64(n))


def shingle_set(words: np.ndarray, n: int = 5) -> np.ndarray:
    """The sorted distinct hashes of n-word shingles; of fewer words the whole sequence as one; of none, none."""
    return np.unique(gram_hashes(words, min(n, len(words)))) if len(words) else NONE


def pieces(batches, rows: int = 512):
    """Arrow batches of (doc_id, text, ...) in slices of a few hundred rows: (ids as a list, texts as bytes or None, the slice)."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            s = b.slice(at, rows)
            yield s.column(0).to_pylist(), s.column(1).cast(pa.large_binary()).to_pylist(), s


def longs(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64))
