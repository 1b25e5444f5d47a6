"""Exact deduplication by a log-structured merge index, in DataFrame operations only.

Memtables flush to runs: tables of digests sorted within each run, one row per digest and run with its extreme identifier.
Every run has a filter, a bitmap of the digests' cells. A digest is a possible hit if its own run holds it twice or another
run's filter has its cell; only possible hits are compacted, which merges equal digests of all runs. Rows of a merged digest
are then compared by their bytes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, texts

#: Bits of a filter bucket, as bitmap_construct_agg makes them.
_BUCKET = 32768


def flush(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", runs: int = 8, bits: int = 256) -> DataFrame:
    """Rows (doc_id, run, digest) as memtables take them: a run per hash of the identifier, stored, sorted by digest within each task, with Parquet's own filters on digest."""
    docs = texts(docs, id_col, text_col)
    digest = F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))
    rows = docs.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(runs)).cast("int").alias("run"), F.substring(digest, 1, bits // 8).alias("digest"))
    return stored(rows.sortWithinPartitions("run", "digest"), **{"parquet.bloom.filter.enabled#digest": "true"})


def compact(runs: DataFrame, keep: str = "largest") -> DataFrame:
    """Merge runs: per digest the extreme identifier and the number of rows. Partial aggregation meets hot digests before the shuffle."""
    best = F.max("keep_id") if keep == "largest" else F.min("keep_id")
    return runs.groupBy("digest").agg(best.alias("keep_id"), F.sum("n").alias("n"))


def possible_hits(memtables: DataFrame, expected: int) -> DataFrame:
    """The memtables' digests (run, digest, keep_id, n) that may occur in more than one row, by the runs' filters."""
    buckets = max(1, expected * 16 // _BUCKET)
    cell = F.pmod(F.xxhash64("digest"), F.lit(buckets * _BUCKET))
    tables = memtables.withColumn("bucket", F.floor(cell / _BUCKET)).withColumn("bit", (cell % _BUCKET).cast("long"))
    filters = tables.groupBy("bucket", "run").agg(F.expr("bitmap_construct_agg(bit)").alias("bitmap"))
    byte = F.conv(F.hex(F.expr("substring(bitmap, cast(bit div 8 as int) + 1, 1)")), 16, 10).cast("int")
    seen = (
        tables.where("n = 1")
        .join(filters.withColumnRenamed("run", "other"), "bucket")
        .where((F.col("other") != F.col("run")) & (F.getbit(byte, (F.col("bit") % 8).cast("int")) == 1))
        .groupBy("run", "digest").agg(F.first("keep_id").alias("keep_id"), F.first("n").alias("n"))
    )
    return seen.unionByName(tables.where("n > 1").select("run", "digest", "keep_id", "n"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", runs: int = 8, bits: int = 256, salts: int = 8, row_col: str | None = None) -> DataFrame:
    """Which documents are copies: of equal texts the row with the largest (or smallest) identifier stays.

    One row per input row: doc_id, keep_id, group_size, kept, text_sha256. Null text counts as empty. Null doc_id: a
    member of its group that stays only if no member has an id. Ties: rows that repeat the identifier that stays are all
    kept, being one document, unless row_col names a column with a key of its own for each row: then one of them stays, and
    the column `row` tells rows apart. bits: length of the digest (256: SHA-256); shorter ones collide, and byte
    verification tells such texts apart. An empty table: no rows. Other columns, whatever their names, are not read. A very
    long text is hashed and compared where it is read; copies of a hot text meet by partial aggregation and over `salts`
    keys, so no task gathers them.
    """
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    row = docs[row_col].cast("long") if row_col else F.lit(0).cast("long")
    source = docs.select(docs[id_col].cast("long").alias("doc_id"), text.alias("text"), row.alias("row"))
    rows = flush(source, "doc_id", "text", runs, bits)
    best = F.max("doc_id") if keep == "largest" else F.min("doc_id")
    memtables = rows.groupBy("run", "digest").agg(best.alias("keep_id"), F.count(F.lit(1)).alias("n"))
    hits = stored(compact(possible_hits(memtables, rows.count()), keep).where("n > 1").select("digest"))

    order = F.max(F.struct("doc_id", "row")) if keep == "largest" else F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))
    salt = F.pmod(F.xxhash64("doc_id", "row"), F.lit(salts)).cast("int").alias("salt")
    every = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")
    # The bytes of all hits: grouped by the text itself within its digest.
    same = (
        source.select("doc_id", "row", "text", F.substring(F.unhex(F.sha2("text", 256)), 1, bits // 8).alias("digest"), salt)
        .join(hits.select("digest", every).hint("merge"), ["digest", "salt"], "left_semi")  # hits grow with the input: never broadcast
        .groupBy("digest", "text").agg(order.alias("best"), F.count(F.lit(1)).alias("group_size"))
        .select(F.sha2("text", 256).alias("text_sha256"), F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row"), "group_size")
    )
    full = source.select("doc_id", "row", F.sha2("text", 256).alias("text_sha256"), salt)
    met = full.join(same.select("*", every), ["text_sha256", "salt"], "left")
    alone = F.col("group_size").isNull()
    kept = alone | F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("row") == F.col("keep_row"))
    out = met.select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.coalesce(kept, F.lit(False)).alias("kept"), "text_sha256", "row")
    return out if row_col else out.drop("row")
