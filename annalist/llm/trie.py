"""Prefix trie of conversations: ROLLUP over blocks of turn columns, each block keyed by the node that the block before it ends in."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

NODE = ("depth", "x0", "x1")
#: Positions that one task sums up; longer conversations are carried on from these.
STRETCH = 4096


def _turn_hashes(turn: Column, depth: Column) -> tuple[Column, Column]:
    """What a turn at a depth adds, by exclusive or, to both halves of a node's key."""
    return F.xxhash64(turn, depth), F.xxhash64(depth, turn, F.lit(1))


def ordered(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(c, pos from 1, t, size) of every turn: its conversation, place in it, 64-bit hash of role and text, and the text's bytes.

    Turns are dealt out by ranges of (conversation, turn, hash), so one conversation may go over many tasks; a turn's place
    is its row in its sorted file, after what earlier files hold of its conversation. Null turns first; turns of one number
    by their hash. Null conversations: left out.
    """
    text = F.coalesce(turns[text_col].cast("string"), F.lit(""))
    rows = turns.select(turns[conv_col].cast("long").alias("c"), turns[turn_col].cast("long").alias("turn"), F.xxhash64(F.coalesce(turns[role_col].cast("string"), F.lit("")), text).alias("t"), F.octet_length(text).cast("long").alias("size")).where("c is not null")
    by = [F.col("c"), F.col("turn").asc_nulls_first(), F.col("t"), F.col("place")]
    dealt = rows.withColumn("place", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by)
    file = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("long")
    kept = stored(dealt.select("c", "t", "size")).select("c", "t", "size", file.alias("file"), F.col("_metadata.row_index").alias("row"))
    runs = kept.groupBy("c", "file").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("c").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("c", "file", (before - F.col("first") + 1).alias("shift"))
    return kept.join(runs, ["c", "file"]).select("c", (F.col("row") + F.col("shift")).alias("pos"), "t", "size")


def rebuilt(turns: DataFrame, group: int = 5, heads: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations with heads in common: (c, n) and (c, pos, t, size), of turns as ordered() gives them.

    c begins with the first h turns of c - c % group, h being crc32(c) % heads, and goes on after its own first h.
    """
    sizes = turns.groupBy("c").agg(F.max("pos").alias("n_own"))
    base = sizes.select(F.col("c").alias("base"), F.col("n_own").alias("n_base"))
    convs = sizes.select("*", (F.col("c") - F.col("c") % group).alias("base"), (F.crc32(F.col("c").cast("string").cast("binary")) % heads).alias("h")).join(base, "base", "left")
    convs = stored(convs.select("c", "base", "h", F.least("h", F.coalesce("n_base", F.lit(0))).alias("m"), "n_own").select("*", (F.col("m") + F.greatest(F.lit(0), F.col("n_own") - F.col("h"))).alias("n")))
    own = turns.join(convs.select("c", "h", "m"), "c").where("pos > h").select("c", (F.col("pos") - F.col("h") + F.col("m")).alias("pos"), "t", "size")
    lent = turns.where(F.col("pos") < heads).withColumnRenamed("c", "base").join(convs.select("c", "base", "h"), "base").where("pos <= h").select("c", "pos", "t", "size")
    return convs.select("c", "n"), own.unionByName(lent)


def _carried(rows: DataFrame, values: dict[str, Column], up: bool) -> DataFrame:
    """rows (c, pos, ...) with running totals of values (name: aggregate) over all rows of c before it, or from it on: within a stretch of positions, and over the totals of the stretches of long conversations."""
    stretch = F.floor((F.col("pos") - 1) / STRETCH)
    totals = rows.groupBy("c", stretch.alias("s")).agg(*[v.alias(k) for k, v in values.items()])
    several = totals.join(totals.where("s > 0").select("c").distinct(), "c", "left_semi")
    near, far = (Window.unboundedPreceding, -1) if up else (0, Window.unboundedFollowing), (Window.unboundedPreceding, -1) if up else (1, Window.unboundedFollowing)
    w = Window.partitionBy("c").orderBy("s").rowsBetween(*far)
    outer = several.select("c", "s", *[_total(k, v, w).alias(f"{k}_far") for k, v in values.items()])
    w = Window.partitionBy("c", "s").orderBy("pos").rowsBetween(*near)
    inner = rows.withColumn("s", stretch).select("*", *[F.coalesce(v.over(w), F.lit(0)).alias(f"{k}_near") for k, v in values.items()])
    both = inner.join(outer, ["c", "s"], "left")
    joined = {k: (F.col(f"{k}_near").bitwiseXOR(F.coalesce(f"{k}_far", F.lit(0))) if up else F.col(f"{k}_near") + F.coalesce(f"{k}_far", F.lit(0))) for k in values}
    return both.select(*rows.columns, *[v.alias(k) for k, v in joined.items()])


def _total(name: str, value: Column, w) -> Column:
    return (F.bit_xor(name) if name.startswith("p") else F.sum(name)).over(w)


def _rolled(blocks: DataFrame, width: int) -> DataFrame:
    """Nodes (depth, x0, x1, px0, px1, conv_id, n_convs, size) of blocks (depth0, p0, p1, t1.., b1.., c): every prefix of a block's turns, after the node (depth0, p0, p1)."""
    ts = [f"t{i}" for i in range(1, width + 1)]
    rolled = blocks.sparkSession.sql(
        f"SELECT depth0, p0, p1, {', '.join(ts)}, grouping_id() AS gid, count(*) AS n_convs, min(c) AS conv_id, {', '.join(f'max(b{i}) AS b{i}' for i in range(1, width + 1))} "
        f"FROM {{blocks}} GROUP BY depth0, p0, p1, ROLLUP ({', '.join(ts)})",
        blocks=blocks,
    )
    level = F.coalesce(*[F.when(F.col("gid") == (1 << (width - i)) - 1, i) for i in range(width + 1)])
    pick = lambda cols: F.coalesce(*[F.when(F.col("level") == i, F.col(c)) for i, c in enumerate(cols, 1)])
    rolled = rolled.withColumn("level", level.cast("long")).withColumn("t", pick(ts)).where("t is not null or (level = 0 and depth0 = 0)")
    depth = F.col("depth0") + F.col("level")

    def key(half: int, upto: Column) -> Column:
        out = F.col(f"p{half}")
        for i, t in enumerate(ts, 1):
            out = out.bitwiseXOR(F.when(upto >= i, _turn_hashes(F.col(t), F.col("depth0") + i)[half]).otherwise(F.lit(0)))
        return out

    size = F.coalesce(pick([f"b{i}" for i in range(1, width + 1)]), F.lit(0))
    return rolled.select(depth.alias("depth"), key(0, F.col("level")).alias("x0"), key(1, F.col("level")).alias("x1"), key(0, F.col("level") - 1).alias("px0"), key(1, F.col("level") - 1).alias("px1"), "conv_id", "n_convs", size.alias("size"))


def _hashed_lists(ends: DataFrame, width: int = 4096) -> DataFrame:
    """For each key of ends (depth, x0, x1, c): the SHA-256 of its numbers c in ascending order, joined by commas. Numbers become text by ranges of `width`; the ranges of a key run through one hash in order."""
    parts = ends.groupBy(*NODE, F.floor(F.col("c") / width).alias("range")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda c: c.cast("string")), ",").alias("part"))

    def run(batches):
        now, state = None, None
        done: list[tuple] = []

        def batch():
            out = pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))], [*NODE, "ends_sha256"])
            done.clear()
            return out

        for b in batches:
            for *key, part in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if key != now:
                    if now:
                        done.append((*now, state.hexdigest()))
                    now, state = key, hashlib.sha256(part.encode())
                else:
                    state.update(b"," + part.encode())
            if len(done) > 10_000:
                yield batch()
        if now:
            done.append((*now, state.hexdigest()))
        yield batch()

    dealt = parts.repartition(*NODE).sortWithinPartitions(*NODE, "range").select(*NODE, "part")
    return dealt.mapInArrow(run, "depth long, x0 long, x1 long, ends_sha256 string")


def nodes(turns: DataFrame, convs: DataFrame, width: int = 8) -> DataFrame:
    """The trie of conversations convs (c, n) with turns (c, pos, t, size): one row per node, all long but the last.

    conv_id (smallest member), depth, parent_conv_id (null at the root), n_convs, n_children, n_leaves and saved_tokens of
    its subtree, ends_sha256 of the members that end there. width: turn columns of a block.
    """
    one, two = _turn_hashes(F.col("t"), F.col("pos"))
    keyed = turns.select("*", one.alias("h0"), two.alias("h1"))
    paths = stored(_carried(keyed, {"p0": F.bit_xor("h0"), "p1": F.bit_xor("h1")}, up=True))
    at = F.pmod(F.col("pos") - 1, F.lit(width)) + 1
    columns = [F.max(F.when(at == i, F.col(v))).alias(f"{k}{i}") for k, v in (("t", "t"), ("b", "size")) for i in range(1, width + 1)]
    blocks = paths.groupBy("c", F.floor((F.col("pos") - 1) / width).alias("j")).agg(*[F.max(F.when(at == 1, F.col(p))).alias(p) for p in ("p0", "p1")], *columns)
    blocks = blocks.select("c", (F.col("j") * width).alias("depth0"), "p0", "p1", *[f"{k}{i}" for k in "tb" for i in range(1, width + 1)])
    turnless = convs.where("n = 0").select("c", *[F.lit(0).cast("long").alias(x) for x in ("depth0", "p0", "p1")], *[F.lit(None).cast("long").alias(f"{k}{i}") for k in "tb" for i in range(1, width + 1)])
    found = stored(_rolled(blocks.unionByName(turnless), width))

    # Children, and what each node is worth; a node belongs to its smallest member, on whose path it lies.
    kids = found.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("px0").alias("x0"), F.col("px1").alias("x1")).agg(F.count(F.lit(1)).alias("n_children"))
    found = stored(found.join(kids, [*NODE], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))).withColumn("worth", (F.col("n_convs") - 1) * F.col("size")))
    owned = found.where("depth > 0 and (worth > 0 or n_children = 0)").select(F.col("conv_id").alias("c"), F.col("depth").alias("pos"), "worth", (F.col("n_children") == 0).cast("long").alias("leaf"))
    worth = paths.join(owned, ["c", "pos"], "left").select("c", "pos", (F.col("p0").bitwiseXOR(F.col("h0"))).alias("x0"), (F.col("p1").bitwiseXOR(F.col("h1"))).alias("x1"), F.coalesce("worth", F.lit(0)).alias("worth"), F.coalesce("leaf", F.lit(0)).alias("leaf"))
    below = _carried(worth, {"saved": F.sum("worth"), "leaves": F.sum("leaf")}, up=False).select(F.col("pos").alias("depth"), "x0", "x1", "saved", "leaves")
    root = [F.lit(0).cast("long").alias(x) for x in NODE]
    whole = owned.select(*root, F.col("worth").alias("saved"), F.col("leaf").alias("leaves"))
    subtree = below.unionByName(whole).groupBy(*NODE).agg(F.sum("saved").alias("saved_tokens"), F.sum("leaves").alias("n_leaves"))

    after = paths.join(convs.select("c", F.col("n").alias("pos")), ["c", "pos"]).select(F.col("pos").alias("depth"), F.col("p0").bitwiseXOR(F.col("h0")).alias("x0"), F.col("p1").bitwiseXOR(F.col("h1")).alias("x1"), "c")
    ends = _hashed_lists(after.unionByName(convs.where("n = 0").select(*root, "c")))

    # The root is one row; a node of many children is split by Spark's handling of skewed joins.
    top = found.where("depth = 0").select(F.col("conv_id").alias("top"))
    parents = found.where("depth > 0 and n_children > 0").select((F.col("depth") + 1).alias("depth"), F.col("x0").alias("px0"), F.col("x1").alias("px1"), F.col("conv_id").alias("parent"))
    deep = found.where("depth > 1").join(parents, ["depth", "px0", "px1"]).select(*found.columns, F.col("parent").alias("parent_conv_id"))
    flat = found.where("depth <= 1").join(F.broadcast(top)).select(*found.columns, F.when(F.col("depth") == 1, F.col("top")).alias("parent_conv_id"))
    out = flat.unionByName(deep).join(subtree, [*NODE], "left").join(ends, [*NODE], "left")
    n_leaves = F.when(F.col("n_children") == 0, 1).otherwise(F.coalesce("n_leaves", F.lit(0))).cast("long")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", n_leaves.alias("n_leaves"), F.coalesce("saved_tokens", F.lit(0)).alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def trie(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", width: int = 8) -> DataFrame:
    """The prefix trie of conversations rebuilt with heads in common; rows as nodes() says.

    A turn is its role and text, null being empty, told apart by a 64-bit hash; a node by 128 bits of its turns and their
    places. Ties: turns of one number go by their hash, null numbers first. Repeated rows: turns each. Null conversation:
    left out. A very long text: hashed where it is read, never moved. A very long conversation: over many tasks and
    blocks. An empty table: no rows, not even a root. Other columns, whatever their names, are not read.
    """
    convs, turns = rebuilt(ordered(conversations, conv_col, turn_col, role_col, text_col))
    return nodes(turns, convs, width)
