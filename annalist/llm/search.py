"""Ranked lexical search, pipelined over owners of terms: bundles of items carry sparse accumulators of documents from one
owner to the next, each owner adds what its terms give, and the last one hands on the best of each bundle."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import CHUNK, bitmap, in_bitmap, pieces, stored, texts, word_hashes

#: Bytes of terms, A-Z lower-cased; all others are blanks.
_TERM = bytes(c if 48 <= c < 58 or 97 <= c < 123 or c >= 128 else c + 32 if 65 <= c < 91 else 32 for c in range(256))
#: Up to so many terms of items, with repeats, are broadcast, as rows of 40 bytes and in lists; more are joined by a shuffle.
BROADCAST_ROWS = 200_000


def counted(data: bytes | None, keep=None) -> tuple[np.ndarray, np.ndarray, int]:
    """A text's distinct terms as 64-bit hashes, those that keep() lets by; how often each occurs; how many terms it has, with repeats. A long text is taken CHUNK bytes at a time, and merged."""
    found, n = [], 0
    data = (data or b"").translate(_TERM)
    at = 0
    while at < len(data):
        cut = len(data) if len(data) - at <= CHUNK else data.rfind(b" ", at, at + CHUNK)
        if cut <= at:
            cut = data.find(b" ", at + CHUNK)
            cut = len(data) if cut < 0 else cut
        h = word_hashes([data[at:cut]])[0]
        n += len(h)
        found.append(np.unique(h[keep(h)] if keep else h, return_counts=True))
        at = cut
    if len(found) == 1:
        return *found[0], n
    h, at_ = np.unique(np.concatenate([x for x, _ in found] or [np.empty(0, np.uint64)]), return_inverse=True)
    tf = np.zeros(len(h), np.int64)
    np.add.at(tf, at_, np.concatenate([x for _, x in found] or [np.empty(0, np.int64)]))
    return h, tf, n


def _postings(docs: DataFrame, wanted, bits: int, block: int) -> DataFrame:
    """One row per document with a term: (block, at, doc_id, n, hs, tfs). A block is up to `block` documents that one task reads, numbered from 0 in the order of their ids."""

    def run(batches):
        part, number, held, size = TaskContext.get().partitionId(), 0, [], 0

        def batch():
            held.sort(key=lambda r: (r[0] is None, r[0] or 0))
            ids, ns, hs, tfs = zip(*held, strict=True)
            edges = pa.array(np.concatenate([[0], np.cumsum([len(h) for h in hs])]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(edges, pa.array(np.concatenate(x).astype(np.int64))) for x in ([h.view(np.int64) for h in hs], tfs)]
            out = pa.RecordBatch.from_arrays([pa.array([part << 24 | number] * len(held), pa.int64()), pa.array(range(len(held)), pa.int32()), pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), *lists], ["block", "at", "doc_id", "n", "hs", "tfs"])
            held.clear()
            return out

        for ids, data, _ in pieces(batches):
            for i, t in zip(ids, data, strict=True):
                h, tf, n = counted(t, lambda h: in_bitmap(wanted.value, bits, h))
                if n:
                    held.append((i, n, h, tf))
                    size += len(h)
                if len(held) == block or size > 1 << 21:
                    yield batch()
                    number, size = number + 1, 0
        if held:
            yield batch()

    return docs.mapInArrow(run, "block long, at int, doc_id long, n long, hs array<long>, tfs array<long>")


def _bundled(table: pa.Table, name: str, kind) -> list[np.ndarray]:
    return [np.frombuffer(x or b"", kind) for x in table.column(name).to_pylist()]


def _stage(owner: int, owners: int, most: int):
    """What an owner does with a bundle (rows of items, with their terms and accumulators) and its postings in the bundle's block: adds contributions, and drops documents that the later owners' terms can't bring among the `most` best. The last one keeps those only."""

    def visit(bundle: pa.Table, postings: pa.Table) -> pa.Table:
        h, at, add = (postings.column(c).to_numpy() for c in ("h", "at", "add"))
        by = np.argsort(h, kind="stable")
        h, at, add = h[by], at[by], add[by]
        edges = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1], [True]])) if len(h) else np.array([0])
        lists = {int(h[a]): (at[a:b], add[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)}
        docs, scores = [], []
        rows = zip(bundle.column("terms").to_pylist(), _bundled(bundle, "docs", np.int32), _bundled(bundle, "scores", np.int64), bundle.column("rest").to_pylist(), strict=True)
        total = np.zeros(1 + max([int(at.max()) if len(at) else 0, *(int(d.max()) for d in _bundled(bundle, "docs", np.int32) if len(d))]), np.int64)
        for terms, d, s, rest in rows:
            total[:] = 0
            total[d] = s
            for t in terms:
                if t in lists:
                    where, what = lists[t]
                    total[where] += what
            kept = np.flatnonzero(total)
            if len(kept) > most:
                worth = total[kept]
                least = np.partition(worth, len(kept) - most)[len(kept) - most]
                kept = kept[worth + sum(rest[owner + 1 :]) >= least]
                if owner == owners - 1:  # equal scores: the smaller ids, which have the smaller numbers
                    kept = kept[np.argsort(-total[kept], kind="stable")][:most]
            docs.append(kept.astype(np.int32).tobytes())
            scores.append(total[kept].tobytes())
        lists_of = pa.list_(pa.int64())
        kept_as = [*(bundle.column(c) for c in ("g", "block", "item")), *(bundle.column(c).cast(lists_of) for c in ("terms", "rest")), pa.array(docs, pa.binary()), pa.array(scores, pa.binary())]
        return pa.Table.from_arrays(kept_as, ["g", "block", "item", "terms", "rest", "docs", "scores"])

    return visit


def rank(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", most: int = 50, owners: tuple[int, ...] = (64, 8), bundle: int = 256, block: int = 1 << 16, bits: int = 1 << 24) -> DataFrame:
    """The `most` best documents for each item: item_id, rank from 1, doc_id, score above 0. Scores are sums of integers.

    owners: terms that fewer than 1 in so many documents hold have an owner of their own, the rarest visited first; so few
    documents have an accumulator until the last. bundle: items that travel together; block: most documents of a bundle's
    accumulators. Both bound what a task holds. bits: of the bitmap of items' terms, by which documents' terms are sorted
    out where they are read; false hits fall in the join. Ties: by doc_id, a null one last. Null or empty texts: no terms,
    no rank. Null item ids: an item each. Repeated rows: ranked each. A very long text: counted in pieces. An empty table:
    no rows. Other columns, whatever their names, are not read. Terms are told apart by 64-bit hashes.
    """
    docs, items = texts(docs, id_col, text_col), texts(items, item_col, item_text)
    spark = docs.sparkSession

    def item_terms(batches):
        for ids, data, _ in pieces(batches):
            hs = [counted(t)[0] for t in data]
            some = [i for i, h in enumerate(hs) if len(h)]
            yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in some], pa.int64()), pa.array([hs[i].view(np.int64) for i in some], pa.list_(pa.int64()))], ["item_id", "terms"])

    asked = stored(items.mapInArrow(item_terms, "item_id long, terms array<long>").withColumn("item", F.monotonically_increasing_id()))
    size = asked.agg(F.count(F.lit(1)).alias("items"), F.sum(F.size("terms")).alias("terms")).first()
    n_items, few = size["items"], (size["terms"] or 0) <= BROADCAST_ROWS
    asked = asked.withColumn("g", F.pmod(F.xxhash64("item"), F.lit(max(1, -(-n_items // bundle)))))
    terms = asked.select("g", "item", F.explode("terms").alias("h"))
    wanted = spark.sparkContext.broadcast(bitmap(terms, "h", bits))
    posted = stored(_postings(docs, wanted, bits, block))
    whole = posted.agg(F.count(F.lit(1)).alias("N"), F.sum("n").alias("L")).first()
    n_docs, n_terms = whole["N"], whole["L"] or 1

    # Weights and owners of the items' terms.
    df = posted.select(F.explode("hs").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("df"))
    weight = F.floor(1000 * F.log((2.0 * n_docs + 2) / (2.0 * F.col("df") + 1))).cast("long")
    owner = F.coalesce(*[F.when(F.col("df") * share < n_docs, i) for i, share in enumerate(owners)], F.lit(len(owners)))
    known = stored(terms.select("h").distinct().join(df, "h").select("h", weight.alias("w"), owner.alias("owner")).where("w > 0"))
    by_bundle = stored(terms.select("g", "h").distinct().join(known, "h"))
    rest = terms.join(known, "h").groupBy("item").pivot("owner", list(range(len(owners) + 1))).agg(F.sum(F.col("w") * 1_000_000))
    waiting = asked.join(rest, "item").select("g", "item", "terms", F.array(*[F.coalesce(F.col(str(i)), F.lit(0)) for i in range(len(owners) + 1)]).alias("rest"))

    m = F.expr(f"50 + (50 * n * {n_docs}) div {n_terms}")
    flat = posted.select("block", "at", m.alias("m"), F.explode(F.arrays_zip("hs", "tfs")).alias("x")).select("block", "at", "m", F.col("x.hs").alias("h"), F.col("x.tfs").alias("tf"))
    adding = flat.join(F.broadcast(by_bundle) if few else by_bundle, "h").select("g", "block", "at", "h", "owner", F.expr("w * ((1000000000 * tf) div (1000 * tf + 20 * m))").alias("add"))

    # Every bundle visits every block that holds a term of it; its items are at most `bundle`.
    blocks = posted.select("block").distinct()
    places = adding.select("g", "block").distinct() if n_items > bundle else blocks.withColumn("g", F.lit(0).cast("long"))
    travelling = places.join(F.broadcast(waiting) if few else waiting, "g").select("g", "block", "item", "terms", "rest", F.lit(b"").alias("docs"), F.lit(b"").alias("scores"))
    schema = "g long, block long, item long, terms array<long>, rest array<long>, docs binary, scores binary"
    for i in range(len(owners) + 1):
        own = adding.where(F.col("owner") == i).select(F.col("g").alias("g_"), F.col("block").alias("block_"), "at", "h", "add")
        travelling = travelling.groupBy("g", "block").cogroup(own.groupBy("g_", "block_")).applyInArrow(_stage(i, len(owners) + 1, most), schema)

    def unpack(batches):
        for b in batches:
            t = pa.Table.from_batches([b])
            d, s = _bundled(t, "docs", np.int32), _bundled(t, "scores", np.int64)
            times = np.array([len(x) for x in d], np.int64)
            first = [pa.array(np.repeat(t.column(c).to_numpy(), times)) for c in ("item", "block")]
            yield pa.RecordBatch.from_arrays([*first, pa.array(np.concatenate([np.empty(0, np.int32), *d])), pa.array(np.concatenate([np.empty(0, np.int64), *s]))], ["item", "block", "at", "score"])

    best = travelling.select("item", "block", "docs", "scores").mapInArrow(unpack, "item long, block long, at int, score long")
    named = stored(best).join(posted.select("block", "at", "doc_id"), ["block", "at"])
    w = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last(), "block", "at")
    ranked = named.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
    return ranked.join(asked.select("item", "item_id"), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
