"""Set-similarity join on word shingles with adaptive multi-match prefixes, up to connected components.

Documents of one shingle set form a class and are joined once. In a global order of shingles, two sets of sizes m <= n
with a Jaccard similarity of p/q or more share at least l of their first n - t + l shingles, t being the least overlap
that n allows. The order puts costly shingles last: those frequent in a sample of the documents, known by a bitmap of a
fixed size. Any order gives the same result, so the sample only sets the cost. A class whose prefix still holds costly
shingles takes a longer one (l up to `most_match`), and a pair is verified only if it may share as many as the smaller l.

A shingle that few classes share gives all their pairs. One that many share gives a group around a hub, the class with
the largest share of costly shingles, and every member is compared with the hub. For members that this leaves in another
component, the group is joined again on what sets them apart from the hub: two sets have as many members apart as their
differences from the hub have, so linked ones share part of these, and the same prefixes serve, now in the order of how
many of the group hold an element. Members far from the hub are joined on their sets. Elements that very many hold give smaller groups around new hubs, until none is left. So
no link between two components is lost, and no group's pairs are all made.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bitmap, in_bitmap, longs, mix, pieces, released, shingle_set, stored, texts, word_hashes

#: Classes sharing a shingle of which all pairs are made.
FEW = 8
#: Pairs sharing what sets them apart from a hub that are compared by their sizes; where there are more, they get a hub of their own.
MEET = 4096
#: Bits of the smallest parity bitmap of a set.
PARITY = 64
#: Tasks over which a costly shingle's or a hub's classes are dealt.
SALTS = 32
_SIG = np.uint64(0xA24BAED4963EE407)


def _class_key(tokens: np.ndarray) -> int:
    """64 bits that stand for a set: a mixed sum over its members."""
    return int(mix(np.array([np.sum(mix(tokens ^ _SIG), dtype=np.uint64) + np.uint64(len(tokens))], np.uint64)).view(np.int64)[0])


def _parity(tokens: np.ndarray) -> np.ndarray:
    """Bits that each member of a set flips one of: two sets have at least as many members apart as their bitmaps have bits apart. As many bits as members or more, a power of two, so that it tells sets of any size apart; a half laid on the other is the bitmap of half as many bits."""
    bits = max(PARITY, 1 << (len(tokens) - 1).bit_length())
    odd = np.bincount((tokens >> np.uint64(24)).astype(np.int64) % bits, minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _prefix(n: int, cheap: int, least: Fraction, most_match: int) -> tuple[int, int]:
    """Length of a set's prefix and its number of matches: one more for each doubling of the costly shingles in the plain prefix."""
    plain = n - -(-n * least.numerator // least.denominator) + 1
    match = min(1 + int(np.log2(1 + max(0, plain - cheap))), most_match, n - plain + 1)
    return plain - 1 + match, match


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes of edges (a, b): the smallest node reachable. Labels spread to neighbours and jump to their own labels until nothing changes."""
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = stored(both.groupBy("a").agg(F.least("a", F.min("b")).alias("l")))
    while True:
        near = both.join(label.select(F.col("a").alias("b"), F.col("l").alias("m")), "b").groupBy("a").agg(F.min("m").alias("m"))
        spread = label.join(near, "a").select("a", "l", F.least("l", "m").alias("m"))
        jumped = spread.join(label.select(F.col("a").alias("m"), F.col("l").alias("far")), "m").select("a", "l", "far")
        after = stored(jumped.select("a", F.col("far").alias("l"), (F.col("far") != F.col("l")).alias("moved")))
        if after.where("moved").isEmpty():
            return after.select(F.col("a").alias("node"), F.col("l").alias("component"))
        label = after.select("a", "l")


def _together(pairs: DataFrame, content: DataFrame, work, out: str, bits: int, salts: int = SALTS) -> DataFrame:
    """pairs (a, b, ...) with the columns `out` that `work` tells of both sets, flags or lists of longs. A set a is sent once to each of `salts` tasks at most, ahead of the sets it meets; sets in no pair stay where they are, but for a few that the bitmap of `bits` lets by."""
    wanted = content.sparkSession.sparkContext.broadcast(bitmap(pairs.select(F.col("a").alias("k")).union(pairs.select("b")), "k", bits))

    def in_pairs(batches):
        for b in batches:
            yield b.filter(pa.array(in_bitmap(wanted.value, bits, b.column(0).to_numpy().view(np.uint64))))

    salt = F.pmod(F.xxhash64("b"), F.lit(salts)).cast("int").alias("salt")
    sets = content.select("k", "tokens").mapInArrow(in_pairs, "k long, tokens binary")
    others = pairs.select("*", salt).join(sets.withColumnRenamed("k", "b").hint("merge"), "b")
    own = pairs.select("a", salt).distinct().join(sets.withColumnRenamed("k", "a").hint("merge"), "a")
    dealt = own.unionByName(others, allowMissingColumns=True).select(*pairs.columns, "tokens", "salt").repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    columns, fields = pairs.columns, [x.split() for x in out.split(", ")]
    kinds = {"boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}

    def run(batches):
        mine = None
        for batch in batches:
            got, at = [], []
            for i, (other, data) in enumerate(zip(batch.column(1).to_pylist(), batch.column(len(columns)).to_pylist(), strict=True)):
                tokens = np.frombuffer(data, np.uint64)
                if other is None:
                    mine = tokens
                else:
                    at.append(i)
                    got.append(work(mine, tokens))
            kept = batch.take(pa.array(at, pa.int64()))
            more = [pa.array([g[i] for g in got], kinds[kind]) for i, (_, kind) in enumerate(fields)]
            yield pa.RecordBatch.from_arrays([*kept.columns[: len(columns)], *more], [*columns, *(name for name, _ in fields)])

    return dealt.mapInArrow(run, ", ".join([*(f"{c} {t}" for c, t in pairs.dtypes), out]))


def link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, least: Fraction = Fraction(3, 4), lower: bool = True, most_match: int = 4, sample: int = 8, bits: int = 1 << 24, few: int = FEW, meet: int = MEET) -> DataFrame:
    """Components of documents linked by a Jaccard similarity of `least` or more between their sets of n-word shingles.

    One row per input row: doc_id, n_shingles, component_id (the smallest doc_id reachable by links, itself included).
    A document of fewer words has its whole sequence as one shingle. Null, empty or blank text: no shingle, linked with
    nothing. Null doc_id: linked like any, but its id stands for no component unless nothing else does. Repeated rows: in
    one class. Ties: a component's id is the smallest whatever was compared first. A very long text: hashed in pieces, its
    set held by one task. An empty table: no rows. Other columns, whatever their names, are not read. Shingles and sets
    are told apart by 64-bit hashes. sample: one of how many documents' shingles are counted to find the costly ones,
    which decides order and speed only; bits: size of that bitmap and of the one of documents to verify.
    """
    docs = texts(docs, id_col, text_col)
    spark = docs.sparkSession
    p, q = least.numerator, least.denominator

    def sets(batches):
        for ids, data, _ in pieces(batches):
            yield ids, [shingle_set(w, n) for w in word_hashes(data, lower)]

    def classes(batches):
        for ids, got in sets(batches):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(t) for t in got], pa.int64()), pa.array([_class_key(t) if len(t) else None for t in got], pa.int64()), pa.array([_parity(t) if len(t) else None for t in got], pa.list_(pa.int64()))], ["doc_id", "n", "k", "parity"])

    def sampled(batches):
        for ids, data, _ in pieces(batches):
            mine = [d for i, d in zip(ids, data, strict=True) if i is not None and hash((i, sample)) % sample == 0]
            for w in word_hashes(mine, lower):
                if len(w):
                    yield pa.RecordBatch.from_arrays([longs(shingle_set(w, n))], ["t"])

    members = stored(docs.mapInArrow(classes, "doc_id long, n long, k long, parity array<long>"))
    costly_rows = docs.mapInArrow(sampled, "t long").groupBy("t").agg(F.count(F.lit(1)).alias("c")).where("c >= 3")
    first = spark.sparkContext.broadcast(bitmap(costly_rows, "t", bits))

    def prefixes(batches, late):
        """A class's key, its set in the global order, how many are not costly, and its prefix's length and number of matches; once a task, however many copies it reads."""
        seen: set[int] = set()
        for _, got in sets(batches):
            for tokens in got:
                if len(tokens) and (k := _class_key(tokens)) not in seen:
                    seen.add(k)
                    costly = in_bitmap(late.value, bits, tokens)
                    cheap = len(tokens) - int(costly.sum())
                    yield k, np.concatenate([tokens[~costly], tokens[costly]]), cheap, *_prefix(len(tokens), cheap, least, most_match)

    def cheap_ones(batches):
        """The shingles of prefixes that are not costly."""
        for _, order, cheap, length, _ in prefixes(batches, first):
            yield pa.RecordBatch.from_arrays([longs(order[: min(length, cheap)])], ["t"])

    def heads(batches):
        """Rows (t, k, what) of prefixes: what holds the class's size, the tasks' number of a costly shingle (6 bits), the class's number of matches (8) and its share of shingles that are not costly (10). Fewer columns are shuffled than told apart."""
        out: list[tuple[np.ndarray, ...]] = []
        size = 0
        for k, order, cheap, length, match in prefixes(batches, costly):
            head = order[:length]
            salt = np.where(np.arange(length) < cheap, 0, 1 + k % SALTS)
            out.append((head, np.full(length, k), len(order) << 24 | salt << 18 | match << 10 | cheap * 1000 // len(order)))
            size += length
            if size > 100_000:
                yield batch_of(out)
                size = 0
        if out:
            yield batch_of(out)

    def batch_of(out):
        t, *rest = (np.concatenate(x) for x in zip(*out, strict=True))
        out.clear()
        return pa.RecordBatch.from_arrays([longs(t), *(pa.array(x.astype(np.int64)) for x in rest)], ["t", "k", "what"])

    def buckets(batches):
        """Of rows (t, k, what) sorted by t, the salt in what, and k: the pairs of classes sharing a rare shingle (t = null); the members (t, a) of one that many share or that is costly. Holds `few` rows at a time."""
        now, held, many = None, [], False
        out: list[tuple] = []

        def close():
            if not many:
                out.extend((None, a, b, na, nb, la, lb, 0) for i, (a, na, la, _) in enumerate(held) for b, nb, lb, _ in held[i + 1 :] if q * min(na, nb) >= p * max(na, nb))

        def batch():
            b = pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True) if out else [()] * 8, (pa.int64(),) * 3 + (pa.int32(),) * 5, strict=True)], ["t", "a", "b", "na", "nb", "la", "lb", "odd"])
            out.clear()
            return b

        for b in batches:
            ts, ks, what = (b.column(i).to_numpy() for i in range(3))
            salts = what >> 18 & 63
            # Of shingles that are not costly, only those met twice in a row matter; the first and last may go on in the neighbouring batches.
            same = np.flatnonzero((salts > 0) | np.concatenate([[True], ts[1:] == ts[:-1]]) | np.concatenate([ts[1:] == ts[:-1], [True]]))
            for t, k, size, match, salt, odd in zip(*(x[same].tolist() for x in (ts, ks, what >> 24, what >> 10 & 255, salts, what & 1023)), strict=True):
                if t != now or salt != dealt:
                    close()
                    now, dealt, held, many, last = t, salt, [], salt > 0, None
                if k == last:
                    continue
                last = k
                if not many:
                    held.append((k, size, match, odd))
                    if len(held) > few:
                        many = True
                        out.extend((t, m, None, s, None, x, None, o) for m, s, x, o in held)
                else:
                    out.append((t, k, None, size, None, match, None, odd))
            if len(out) > 10_000:
                yield batch()
        close()
        yield batch()

    del costly_rows
    released(spark)
    # Shingles of many prefixes are costly too, and go last in a second pass.
    again = bitmap(docs.mapInArrow(cheap_ones, "t long").groupBy("t").agg(F.count(F.lit(1)).alias("c")).where(f"c > {few}"), "t", bits)
    released(spark)
    costly = spark.sparkContext.broadcast(first.value | again)
    salt = F.expr("shiftright(what, 18) & 63")
    dealt = docs.mapInArrow(heads, "t long, k long, what long").repartition("t", salt).sortWithinPartitions("t", salt, "k")
    near = stored(dealt.mapInArrow(buckets, "t long, a long, b long, na int, nb int, la int, lb int, odd int"))
    del dealt
    released(spark)

    common = near.where("t is not null").select("t", F.col("a").alias("k"), F.col("na").alias("n"), "odd").distinct()
    hubs = common.groupBy("t").agg(F.min(F.struct("odd", "k", "n")).alias("h"), F.count(F.lit(1)).alias("c")).where("c > 1").select("t", F.col("h.k").alias("hub"), F.col("h.n").alias("hub_n"))
    in_common = stored(common.join(hubs, "t"))
    groups = stored(in_common.where("k <> hub").select(F.col("hub").alias("g"), "hub", "hub_n", "k", "n").distinct())

    # Of pairs in rare shingles, those that may share as many of their prefixes as the smaller number of matches.
    more = in_common.groupBy("k").agg(F.count(F.lit(1)).alias("more"))
    rare = near.where("t is null").groupBy("a", "b", "na", "nb", "la", "lb").agg(F.count(F.lit(1)).alias("c"))
    rare = rare.join(more.select(F.col("k").alias("a"), F.col("more").alias("ca")), "a", "left").join(more.select(F.col("k").alias("b"), F.col("more").alias("cb")), "b", "left")
    todo = stored(rare.where(F.col("c") + F.least(F.coalesce("ca", F.lit(0)), F.coalesce("cb", F.lit(0))) >= F.least("la", "lb")).select("a", "b"))

    def in_any(pairs: DataFrame, groups: DataFrame) -> DataFrame:
        return pairs.select(F.col("a").alias("k")).union(pairs.select("b")).union(groups.select("k")).union(groups.select("hub")).distinct().hint("merge")

    light = stored(members.join(in_any(todo, groups), "k", "left_semi").select("k", "n", "parity").dropDuplicates(["k"]))
    # Sets are fetched of classes in pairs that may be linked, and of the members of groups of three or more.
    first_pairs = stored(_near(todo.unionByName(_stars(groups, p, q)).distinct(), light, p, q))
    several = groups.join(groups.groupBy("g").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "g", "left_semi")
    firsts = members.where("k is not null").groupBy("k").agg(F.min(F.coalesce("doc_id", F.lit(-1))).alias("d")).join(in_any(first_pairs, several), "k", "left_semi")
    needed = spark.sparkContext.broadcast(bitmap(firsts, "d", bits))

    def contents(batches):
        """Sets of each wanted class's first document, and of a few others that the bitmap lets by."""
        for ids, got in sets(batches):
            may = in_bitmap(needed.value, bits, np.array([-1 if i is None else i for i in ids], np.int64).view(np.uint64)) if ids else []
            keep = [t for t, m in zip(got, may, strict=True) if m and len(t)]
            yield pa.RecordBatch.from_arrays([pa.array([_class_key(t) for t in keep], pa.int64()), pa.array([t.tobytes() for t in keep], pa.binary())], ["k", "tokens"])

    content = stored(docs.mapInArrow(contents, "k long, tokens binary"))
    del rare, more, common, hubs, in_common, several, firsts
    released(spark)
    named = _linked(first_pairs, groups, content, light, p, q, meet, bits)

    of_class = members.where("k is not null").groupBy("k").agg(F.min("doc_id").alias("first"))
    of_component = _labelled(of_class, named, "k", "c")
    smallest = of_component.groupBy("c").agg(F.min("first").alias("component_id"))
    by_class = of_component.join(smallest, "c").select("k", "component_id")
    return members.join(by_class, "k", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def _labelled(df: DataFrame, named: DataFrame, key: str, name: str) -> DataFrame:
    return df.join(named.select(F.col("node").alias(key), F.col("component").alias("c_")), key, "left").withColumn(name, F.coalesce("c_", key)).drop("c_")


def _stars(groups: DataFrame, p: int, q: int) -> DataFrame:
    """Pairs (a, b) of hubs with the members of groups whose sizes allow a link."""
    return groups.where(f"{q} * least(hub_n, n) >= {p} * greatest(hub_n, n)").select(F.col("hub").alias("a"), F.col("k").alias("b"))


def _near(pairs: DataFrame, light: DataFrame, p: int, q: int) -> DataFrame:
    """Pairs (a, b) whose parity bitmaps, laid together at the smaller one's number of bits, allow a link: linked sets of m and n members have (m + n) (q - p) / (q + p) members apart at most."""
    both, long = F.concat("p1", "p2"), F.least(F.size("p1"), F.size("p2"))
    part = lambda i: F.slice(both, i * long + 1, long)
    laid = F.aggregate(F.sequence(F.lit(1), (F.size(both) / long).cast("int") - 1), part(F.lit(0)), lambda got, i: F.zip_with(got, part(i), lambda x, y: x.bitwiseXOR(y)))
    apart = F.aggregate(laid, F.lit(0), lambda x, y: x + F.bit_count(y))
    side = lambda c, s: light.select(F.col("k").alias(c), F.col("n").alias("n" + s), F.col("parity").alias("p" + s)).hint("merge")
    return pairs.join(side("a", "1"), "a").join(side("b", "2"), "b").where((q + p) * apart <= (q - p) * (F.col("n1") + F.col("n2"))).select("a", "b")


def _linked(todo: DataFrame, groups: DataFrame, content: DataFrame, light: DataFrame, p: int, q: int, meet: int, bits: int) -> DataFrame:
    """(node, component) of classes: links among the pairs `todo` (a, b), and between components among the members of groups (g, hub, hub_n, k, n)."""
    linked = lambda x, y: ((i := len(np.intersect1d(x, y, assume_unique=True))) * q >= p * (len(x) + len(y) - i),)

    def centred(hub: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What sets x apart from the hub if that is little, and x itself if it is much; both between. A set with n members and over n apart from the hub has no link with one that has under half as many apart as members."""
        d = np.setxor1d(hub, x, assume_unique=True)
        none = np.empty(0, np.int64)
        return d.view(np.int64) if 2 * p * len(d) <= (3 * q - 2 * p) * len(x) else none, x.view(np.int64) if 2 * len(d) > len(x) else none

    checked = edges = named = None
    while True:
        new = todo.withColumn("x", F.least("a", "b")).withColumn("y", F.greatest("a", "b")).groupBy("x", "y").agg(F.min(F.struct("a", "b")).alias("p")).select("x", "y", "p.a", "p.b")
        if checked is not None:
            new = new.join(checked, ["x", "y"], "left_anti")
        new = stored(new)
        judged = stored(_together(new.select("a", "b") if checked is None else stored(_near(new, light, p, q)), content, linked, "linked boolean", bits))
        released(content.sparkSession)
        pairs, found = new.select("x", "y"), judged.where("linked").select("a", "b")
        checked, edges = (pairs, found) if checked is None else (checked.unionByName(pairs), edges.unionByName(found))
        if named is None or not found.isEmpty():
            named = components(edges)

        # Groups with members in another component than their hub's.
        of_hub = _labelled(groups.select("g", "hub").distinct(), named, "hub", "hub_c")
        now = stored(_labelled(groups, named, "k", "c").join(of_hub.select("g", "hub_c"), "g").select(F.col("hub").alias("a"), F.col("k").alias("b"), "g", "n", "hub_n", "c", (F.col("c") != F.col("hub_c")).alias("apart")))
        if now.where("apart").isEmpty():
            return named
        now = now.join(now.where("apart").select("g").distinct(), "g", "left_semi").select(now.columns)
        both = stored(_together(now, content, centred, "d array<long>, own array<long>", bits)).select(F.col("b").alias("k"), "*")
        released(content.sparkSession)
        near_hub = both.where("size(d) > 0").select("g", "k", "n", "hub_n", "c", "apart", "d")
        far = both.where("size(own) > 0").select(F.xxhash64("g").alias("g"), "k", "n", F.lit(0).alias("hub_n"), "c", F.lit(True).alias("apart"), F.col("own").alias("d"))
        left, right = _openings(near_hub.unionByName(far), p, q)

        # Elements that few hold give pairs, the others groups around new hubs.
        held = stored(left.groupBy("g", "e").agg(F.count(F.lit(1)).alias("l"), F.min(F.struct("odd", "k", "n")).alias("h")).join(right.groupBy("g", "e").agg(F.count(F.lit(1)).alias("r")), ["g", "e"]))
        rare, common = held.where(f"l * r <= {meet}").select("g", "e"), held.where(f"l * r > {meet}")
        side = lambda df, s: df.select("g", "e", *[F.col(c).alias(c + s) for c in ("k", "n", "c", "d_n", "rest")])
        # At the first element that two share, what is left of either's elements bounds what they share; at later ones the pair need not come again.
        met = side(left.join(rare, ["g", "e"], "left_semi"), "1").join(side(right, "2"), ["g", "e"])
        may = f"k1 <> k2 and c1 <> c2 and {q} * least(n1, n2) >= {p} * greatest(n1, n2) and {q + p} * (d_n1 + d_n2 - 2 * least(rest1, rest2)) <= {q - p} * (n1 + n2)"
        todo = met.where(may).select(F.least("k1", "k2").alias("a"), F.greatest("k1", "k2").alias("b")).distinct()
        around = common.select("g", "e", F.col("h.k").alias("hub"), F.col("h.n").alias("hub_n"))
        both = left.select("g", "e", "k", "n").unionByName(right.select("g", "e", "k", "n")).join(around, ["g", "e"]).where("k <> hub")
        # A group around a new hub is smaller than the one it comes from by that hub at least, so this ends.
        groups = stored(both.select(F.xxhash64("g", "hub").alias("g"), "hub", "hub_n", "k", "n").distinct())
        todo = todo.unionByName(_stars(groups, p, q))
        meet *= 16


def _openings(apart: DataFrame, p: int, q: int) -> tuple[DataFrame, DataFrame]:
    """Prefixes (g, e, k, n, c, d_n, rest, odd) of differences d from the group's hub: of members in another component than the hub's, and of all.

    Linked sets of m and n members have (m + n) (q - p) / (q + p) members apart at most, and the same number of elements
    of their differences, whose sizes say so how many these share. A member in another component isn't linked with the
    hub, which bounds the size of its difference from below. Only elements that another member holds too can be shared,
    and one of both is in another component than the hub.
    """
    rows = apart.select("g", "k", "n", "hub_n", "c", "apart", F.size("d").cast("long").alias("d_n"), F.explode("d").alias("e"))
    f = rows.groupBy("g", "e").agg(F.count(F.lit(1)).alias("f"), F.max("apart").alias("any")).where("f > 1 and any").select("g", "e", "f")
    kept = rows.join(f, ["g", "e"]).groupBy("g", "k", "n", "hub_n", "c", "apart", "d_n").agg(F.sort_array(F.collect_set(F.struct("f", "e"))).alias("es"))
    any_partner: Column = F.expr(f"greatest(1, d_n - ((n + n * {q} div {p}) * {q - p}) div {q + p})")
    apart_partner: Column = F.expr(f"cast(ceil((({q + p}) * d_n + ({q - p}) * (hub_n - n)) / {2 * (q + p)}) as bigint)")
    whole: Column = F.when(F.col("hub_n") == 0, F.expr(f"(n * {p} + {q - 1}) div {q}")).otherwise(1)
    kept = stored(kept.select("g", "k", "n", "c", "apart", "d_n", "es", F.size("es").cast("long").alias("shared"), F.greatest(any_partner, whole).alias("need"), F.greatest(any_partner, apart_partner, whole).alias("need_apart")))

    def opening(df: DataFrame, need: str) -> DataFrame:
        length = F.col("shared") - F.col(need) + 1
        df = df.where(length > 0).select("*", F.posexplode(F.slice("es", F.lit(1), length.cast("int"))).alias("at", "x"))
        return df.select("g", F.col("x.e").alias("e"), "k", "n", "c", "d_n", (F.col("shared") - F.col("at")).alias("rest"), ((F.col("d_n") - F.col("shared")) / F.col("n")).alias("odd"))

    return opening(kept.where("apart"), "need"), opening(kept, "need_apart")
