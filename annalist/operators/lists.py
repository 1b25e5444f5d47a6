"""Lists of lines against items: each line claims the items that it stands for, each item is claimed once; and how far two lists overlap when titles are only near."""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from annalist.functions.ratios import indel
from annalist.operators.curation import cut
from annalist.operators.similar import near_between

#: How a line came by its items, in the order in which a line tries.
BY = ("hand", "title", "id", "close")


def _edges(lines: DataFrame, items: DataFrame, links: DataFrame | None) -> DataFrame:
    """(parent, line, how, key, item, score) of all that a line may claim. how: 0 a link by hand, 1 the same key, 2 the same id, 3 the same but for blanks, 4 a prefix of whole words, 5 near; items of one parent and key stand together."""
    keys = items.select("parent", "key").distinct()
    no_item, no_score = F.lit(None).cast("long").alias("item"), F.lit(0.0).alias("score")
    of = lambda how: F.lit(how).alias("how")
    edges = lines.join(keys, ["parent", "key"]).select("parent", "line", of(1), "key", no_item, no_score)
    last = items.where("id is not null").groupBy("parent", "id").agg(F.max(F.struct("item", "key")).alias("x"))
    edges = edges.unionByName(lines.where("id is not null").join(last, ["parent", "id"]).select("parent", "line", of(2), F.col("x.key").alias("key"), F.col("x.item").alias("item"), no_score))

    tight = F.regexp_replace("key", " ", "").alias("tight")
    li, it = lines.select("parent", "line", F.col("key").alias("k"), tight), keys.select("parent", "key", tight)
    edges = edges.unionByName(li.join(it, ["parent", "tight"]).select("parent", "line", of(3), "key", no_item, no_score))
    # Beginnings of a text that end before a blank.
    openings = lambda c: F.transform(F.sequence(F.lit(1), F.size(F.split(c, " ")) - 1), lambda i: F.array_join(F.slice(F.split(c, " "), F.lit(1), i), " "))
    some = F.size(F.split("k", " ")) > 1
    long = li.where(F.length("k") >= 4)
    shorter = long.where(some).select("parent", "line", F.explode(openings("k")).alias("key")).join(keys, ["parent", "key"]).select("parent", "line", of(4), "key", no_item, no_score)
    longer = keys.where(F.size(F.split("key", " ")) > 1).select("parent", "key", F.explode(openings("key")).alias("k")).join(long.select("parent", "line", "k"), ["parent", "k"]).select("parent", "line", of(4), "key", no_item, no_score)
    edges = edges.unionByName(shorter).unionByName(longer)
    # near_between() says "" for a null block; parents are none.
    near = near_between(li.where(F.length("tight") >= 5).select(F.col("parent").alias("block"), F.col("tight").alias("t")), it.select(F.col("parent").alias("block"), F.col("tight").alias("t")), 85)
    near = li.select(F.col("parent").cast("string").alias("block"), "parent", "line", F.col("tight").alias("x")).join(near, ["block", "x"]).select("parent", "line", F.col("y").alias("tight"), F.col("ratio").alias("score")).join(it, ["parent", "tight"])
    edges = edges.unionByName(near.select("parent", "line", of(5), "key", no_item, "score"))
    if links is not None:
        hand = lines.groupBy("parent", "l_").agg(F.min("line").alias("line")).join(links, ["parent", "l_"])
        edges = edges.unionByName(hand.join(items.select("parent", "item", "key"), ["parent", "item"]).select("parent", "line", of(0), "key", "item", no_score))
    return edges


def _claim(at: Callable[[int], list], used: set[str], margin: float) -> tuple | None:
    """(by, key, item, open): what a line takes of its edges (key, item, score, open, spoken, linked), at(how) in order, once keys are used; item: the one claimed besides what is open of its key."""
    if by_hand := at(0):
        key, item = by_hand[0][:2]
        return "hand", key, item, key not in used
    own = [e for e in at(1) if e[0] not in used and e[3] > 0]
    ids = [e for e in at(2) if not e[5] and e[0] not in used and not (own and e[0] == own[0][0])]
    if ids or own:
        return "id" if ids else "title", (ids or own)[0][0], ids[0][1] if ids else None, True
    for h in (3, 4, 5):
        free = [e for e in at(h) if e[0] not in used and e[4] == 0]
        if free:
            if h == 5:
                free.sort(key=lambda e: -e[2])
                if len(free) > 1 and free[0][2] - free[1][2] < margin:
                    return None
                free = free[:1]
            return ("close", free[0][0], None, True) if len({e[0] for e in free}) == 1 else None
    return None


def _openings(words: str) -> list[str]:
    """Beginnings of a text that end before a blank."""
    return [words[:i] for i, c in enumerate(words) if c == " "]


@functools.lru_cache(1 << 16)
def _near(a: str, b: str) -> float:
    return indel(a, b) if 200 * min(len(a), len(b)) >= 85 * (len(a) + len(b)) else 0.0


def _settled(links: dict, items: list[tuple], lines: list[tuple], margin: float) -> list[tuple]:
    """(line, item, by) of one short list: links title -> item, items (item, key, id), lines (line, key, id, title) in order. What a line may claim is looked up only once it comes to it."""
    titles: dict[str, object] = {}
    for line, _, _, title in lines:
        if title is not None:
            titles.setdefault(title, line)
    spoken = {item for title, item in links.items() if title in titles}
    keys: dict[str, list] = {}
    last: dict[str, tuple] = {}
    of_item: dict[object, list[str]] = {}
    for item, key, id_ in items:
        keys.setdefault(key, []).append(item)
        of_item.setdefault(item, []).append(key)
        here = item is not None, item, key
        if id_ is not None and (id_ not in last or here > last[id_]):
            last[id_] = here
    state = {key: ((n := sum(i in spoken for i in v if i is not None)), len(v) - n) for key, v in keys.items()}
    edge = lambda key, item=None, score=0.0: (key, item, score, state[key][1], state[key][0], item is not None and item in spoken)
    hand: dict[object, list] = {}
    for title, item in links.items():
        if title in titles and item in of_item:
            hand.setdefault(titles[title], []).extend((key, item) for key in of_item[item])
    tight: dict[str, list[str]] = {}
    begun: dict[str, list[str]] = {}
    used: set[str] = set()
    out = []
    k = 0
    while k < len(lines):
        line, mine = lines[k][0], []
        while k < len(lines) and lines[k][0] == line:
            mine.append(lines[k])
            k += 1

        def at(how, line=line, mine=mine):
            own = [x[1] for x in mine if x[1] is not None]
            if how == 0:
                return [edge(key, item) for key, item in sorted(hand.get(line, ()), key=lambda x: x[0])]
            if how == 1:
                found = [key for key in own if key in keys]
            elif how == 2:
                met = sorted({last[x[2]] for x in mine if x[2] in last}, key=lambda x: x[2])
                return [edge(key, item if there else None) for there, item, key in met]
            elif how == 3:
                if not tight:
                    for key in keys:
                        tight.setdefault(key.replace(" ", ""), []).append(key)
                found = [key for x in own for key in tight.get(x.replace(" ", ""), ())]
            elif how == 4:
                if not begun:
                    for key in keys:
                        for x in _openings(key):
                            begun.setdefault(x, []).append(key)
                found = [key for x in own if len(x) >= 4 for key in (*(o for o in _openings(x) if o in keys), *begun.get(x, ()))]
            else:
                scores = {(key, score) for x in own if len(t := x.replace(" ", "")) >= 5 for u, v in tight.items() if u and (score := _near(t, u)) >= 85 for key in v}
                return [edge(key, None, score) for key, score in sorted(scores, key=lambda x: (-x[1], x[0]))]
            return [edge(key) for key in sorted(set(found))]

        if claim := _claim(at, used, margin):
            by, key, own_, open_ = claim
            used.add(key)
            out += [(line, item, by) for item in keys[key] if (own_ is not None and item == own_) or (open_ and (item is None or item not in spoken))]
    return out


def match_lists(lines: DataFrame, items: DataFrame, links: DataFrame | None = None, margin: float = 8, short: int = 256) -> DataFrame:
    """(parent, line, item, by): items of each line of a parent's list; lines without any are left out, as are items that no line claims.

    lines (parent, line, title, key, id), items (parent, item, key, id), links (parent, title, item). Lines go in order.
    An item linked by hand to a line's title, case aside, is that line's, with the items of its key, and no other's. Then
    the unclaimed items of the line's own key; but if the line's id is an item's that isn't among them, that item and those
    of its key. A line without any takes the items of one key that none of is claimed: the only one that is the same but
    for blanks; if there is none, and the line has four characters, the only one that begins the other by whole words; if
    there is none, and it has five, the nearest of ratio 85 or more, blanks aside, that is `margin` ahead of the next.

    A parent's rows meet once, by one shuffle. Lists of up to `short` rows in all are settled there and then; what lines of
    longer ones may claim is found by joins for all of them at once, so that none is paired with itself; only the order of
    claims is kept line by line, in a sorted stream that holds the keys one parent has claimed. Null parents, titles and
    keys claim nothing. Of items with one id the largest stands for it; of links of one title the largest item.
    """
    low = F.lower(F.trim("title")).alias("l_")
    none = lambda df, c: F.lit(None).cast(df.schema[c].dataType).alias(c)
    row = lambda kind, *cols: (F.lit(kind).alias("kind"), *cols)
    no_title = F.lit(None).cast("string").alias("l_") if links is None else low
    all_ = lines.where("parent is not null and line is not null").select("parent", *row(2, "line", none(items, "item"), F.nullif(F.col("key"), F.lit("")).alias("key"), "id", no_title))
    all_ = all_.unionByName(items.where("parent is not null and key <> ''").select("parent", *row(1, none(lines, "line"), "item", "key", "id", F.lit(None).cast("string").alias("l_"))))
    if links is not None:
        top = links.where("parent is not null and title is not null").groupBy("parent", low).agg(F.max("item").alias("item"))
        all_ = all_.unionByName(top.select("parent", *row(0, none(lines, "line"), "item", none(items, "key"), none(items, "id"), "l_")))
    whole = Window.partitionBy("parent").orderBy("kind", "line").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    all_ = all_.withColumn("n_", F.count(F.lit(1)).over(whole))
    kinds = {c: all_.schema[c].dataType.simpleString() for c in all_.columns}

    def settle(batches):
        """From rows sorted by parent, kind and line, a parent's all in one task."""
        now, links_, items_, lines_ = None, {}, [], []
        out: list[tuple] = []
        schema = None

        def batch():
            b = pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(schema)], ["parent", "line", "item", "by"])
            out.clear()
            return b

        def end():
            if items_ and lines_:
                out.extend((now, *x) for x in _settled(links_, items_, lines_, margin))

        for b in batches:
            schema = schema or [*(b.schema.field(c).type for c in ("parent", "line", "item")), pa.string()]
            for parent, kind, line, item, key, id_, title in zip(*(b.column(c).to_pylist() for c in ("parent", "kind", "line", "item", "key", "id", "l_")), strict=True):
                if parent != now:
                    end()
                    now, links_, items_, lines_ = parent, {}, [], []
                if kind == 2:
                    lines_.append((line, key, id_, title))
                elif kind == 1:
                    items_.append((item, key, id_))
                else:
                    links_[title] = item
            if len(out) > 10_000:
                yield batch()
        end()
        if out:
            yield batch()

    settled = all_.where(F.col("n_") <= short).drop("n_").sortWithinPartitions("parent", "kind", "line").mapInArrow(settle, f"parent {kinds['parent']}, line {kinds['line']}, item {kinds['item']}, by string")
    # Passed through Arrow, so that no join below pulls its filter or columns under the shuffle, and all read the same one.
    long = all_.where(F.col("n_") > short).drop("n_").repartition("parent", "kind").mapInArrow(lambda batches: batches, ", ".join(f"{c} {k}" for c, k in kinds.items() if c != "n_"))
    return settled.unionByName(_joined(long.where("kind = 2"), long.where("kind = 1").select("parent", "item", "key", "id"), None if links is None else long.where("kind = 0").select("parent", "l_", "item"), margin))


def _joined(lines: DataFrame, items: DataFrame, links: DataFrame | None, margin: float) -> DataFrame:
    """match_lists() of lines (parent, line, key, id, l_), items and links (parent, l_, item) by joins, l_ being a title's key."""
    if links is not None:
        spoken = links.join(lines.select("parent", "l_").distinct(), ["parent", "l_"], "left_semi").select("parent", "item").distinct().withColumn("linked", F.lit(True))
        items = items.join(spoken, ["parent", "item"], "left")
    else:
        items = items.withColumn("linked", F.lit(None).cast("boolean"))
    state = items.groupBy("parent", "key").agg(F.count(F.when(F.col("linked").isNull(), 1)).alias("open"), F.count("linked").alias("spoken"))
    edges = _edges(lines, items, links).join(state, ["parent", "key"])
    kind = edges.schema["parent"].dataType.simpleString(), edges.schema["line"].dataType.simpleString()
    with_link = edges.join(items.where("linked").select("parent", "item", "linked"), ["parent", "item"], "left")

    def claims(batches):
        """From edges sorted by parent, line and how: (parent, line, by, key, item, open)."""
        now = line = None
        used: set[str] = set()
        held: list[tuple] = []
        out: list[tuple] = []

        def decide():
            nonlocal held
            mine, held = held, []
            if claim := _claim(lambda h: [e[3:] for e in mine if e[2] == h], used, margin):
                out.append((*mine[0][:2], *claim))
                used.add(claim[1])

        def batch(schema):
            b = pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], schema[i]) for i in range(6)], ["parent", "line", "by", "key", "item", "open"])
            out.clear()
            return b

        schema = None
        for b in batches:
            schema = schema or [b.schema.field("parent").type, b.schema.field("line").type, pa.string(), pa.string(), pa.int64(), pa.bool_()]
            for e in zip(*(b.column(i).to_pylist() for i in range(9)), strict=True):
                if (e[0], e[1]) != (now, line):
                    if held:
                        decide()
                    if e[0] != now:
                        used = set()
                    now, line = e[:2]
                held.append(e)
            if len(out) > 10_000:
                yield batch(schema)
        if held:
            decide()
        if out:
            yield batch(schema)

    dealt = with_link.select("parent", "line", "how", "key", "item", "score", "open", "spoken", F.coalesce("linked", F.lit(False)).alias("linked")).distinct().repartition("parent").sortWithinPartitions("parent", "line", "how", F.desc("score"), "key")
    claimed = dealt.mapInArrow(claims, f"parent {kind[0]}, line {kind[1]}, by string, key string, item long, open boolean").select("parent", "line", "by", "key", F.col("item").alias("own_"), F.col("open").alias("open_"))
    met = claimed.join(items, ["parent", "key"]).where((F.col("item") == F.col("own_")) | (F.col("open_") & F.col("linked").isNull()))
    return met.select("parent", "line", "item", "by")


def list_overlap(items: DataFrame, pairs: DataFrame, ratio: float = 90) -> DataFrame:
    """pairs (a, b, ...) with n_a, n_b and shared: how many distinct titles each list of items (parent, title) has, and how many of a's have the same or a near one in b. Null and empty titles: none.

    Only lists in pairs are read. Distinct titles are matched once, all against all by near_between(), so no list is paired
    with a list however many pairs there are: a pair meets the matches of a's titles, and counts those that b has.
    """
    pairs = cut(pairs)  # read five times
    p = pairs.select("a", "b").distinct()
    ends = p.select(F.explode(F.array("a", "b")).alias("parent")).distinct()
    d = items.where("title <> ''").select("parent", "title").join(ends, "parent", "left_semi").distinct()
    size = d.groupBy("parent").agg(F.count(F.lit(1)).alias("n"))
    sides = lambda c: p.select(F.col(c).alias("parent")).distinct()
    titles = lambda c: d.join(sides(c), "parent", "left_semi").select(F.lit("").alias("block"), F.col("title").alias("t")).distinct()
    near = near_between(titles("a"), titles("b"), ratio).select(F.col("x").alias("title"), "y")
    mine = p.join(d.withColumnRenamed("parent", "a"), "a").join(near, "title")
    met = mine.join(d.select(F.col("parent").alias("b"), F.col("title").alias("y")), ["b", "y"]).groupBy("a", "b").agg(F.countDistinct("title").alias("shared"))
    n = lambda c: size.select(F.col("parent").alias(c), F.col("n").alias(f"n_{c}"))
    out = pairs.join(met, ["a", "b"], "left").join(n("a"), "a", "left").join(n("b"), "b", "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    return out.select(*pairs.columns, z("n_a").alias("n_a"), z("n_b").alias("n_b"), z("shared").alias("shared"))


def near_titles(titles: DataFrame, ratio: float = 90) -> DataFrame:
    """(title, x): different titles of a table (title) whose indel ratio is `ratio` or more, both ways; stored."""
    t = titles.select(F.lit("").alias("block"), F.col("title").alias("t")).distinct()
    return cut(near_between(t, t, ratio).where("x <> y").select(F.col("y").alias("title"), "x"))


def overlap_within(members: DataFrame, items: DataFrame, near: DataFrame, carry: Sequence[str] = (), few: int = 4096, titles: int = 500_000) -> DataFrame:
    """(a, b, ratio, alike, n_a, n_b, shared, carry): every two members (block, key, text, carry) of one block, both ways and each with itself.

    ratio: the indel ratio of their texts, null without one; alike: how many of the block have a's text; n_a, n_b and shared
    as list_overlap() has them, near being near_titles() of the items' titles; carry: columns of a. Null blocks and keys are
    left out; keys are unique.

    The result has a row for each pair, but nothing of that size is shuffled or held: members are, with their titles and
    those near them. A block is dealt by parts of about `few` members or so many `titles`; a part is held in a task as the
    whole block passes by, and pairs go out as they are counted.
    """
    m = members.where("block is not null and key is not null").select("block", "key", "text", *carry)
    alike = m.groupBy("block", "text").agg(F.count(F.lit(1)).alias("alike"))
    m = m.join(alike, ["block", "text"], "left")
    d = items.where("title <> ''").select(F.col("parent").alias("key"), "title").distinct()
    # Titles near one of a list's, besides its own.
    more = d.join(near, "title").select("key", F.col("x").alias("title")).distinct().join(d, ["key", "title"], "left_anti").groupBy("key").agg(F.collect_list("title").alias("more"))
    own = d.groupBy("key").agg(F.collect_list("title").alias("own"))
    empty = F.array().cast("array<string>")
    m = m.join(own, "key", "left").join(more, "key", "left").withColumns({"own": F.coalesce("own", empty), "more": F.coalesce("more", empty)})
    size = m.groupBy("block").agg(F.ceil(F.greatest(F.count(F.lit(1)) / few, F.sum(F.size("own") + F.size("more")) / titles)).cast("int").alias("parts_"))
    dealt = m.join(size, "block").withColumn("home_", F.pmod(F.xxhash64("key"), F.col("parts_")).cast("int")).select("*", F.explode(F.sequence(F.lit(0), F.col("parts_") - 1)).alias("part_"))
    dealt = dealt.select("block", "part_", (F.col("home_") != F.col("part_")).alias("passing"), "key", F.col("text").cast("string").alias("text"), "alike", "own", "more", *carry).repartition("block", "part_").sortWithinPartitions("block", "part_", "passing")
    kind = dealt.schema
    out = f"a {kind['key'].dataType.simpleString()}, b {kind['key'].dataType.simpleString()}, ratio double, alike long, n_a long, n_b long, shared long" + "".join(f", {c} {kind[c].dataType.simpleString()}" for c in carry)
    dealt = dealt.withColumn("part_", F.xxhash64("block", "part_")).drop("block")
    return dealt.mapInArrow(functools.partial(_pairs_of_parts, carry=tuple(carry)), out)


def _pairs_of_parts(batches, carry: tuple[str, ...]):
    """overlap_within() of rows sorted by part, those at home there before those that pass by."""
    held: list[pa.RecordBatch] = []
    part, home = None, None
    for b in batches:
        parts, passing = b.column("part_").to_numpy(), b.column("passing").to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero((parts[1:] != parts[:-1]) | (passing[1:] != passing[:-1])) + 1).tolist(), len(parts)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if lo == hi:
                continue
            if parts[lo] != part:
                if held:
                    yield from _Home(held, carry).meet_all(held)
                held, home, part = [], None, parts[lo]
            if not passing[lo]:
                held.append(b.slice(lo, hi - lo))
                continue
            if home is None:
                if not held:
                    continue
                home, first = _Home(held, carry), held
                held = []
                yield from home.meet_all(first)
            yield from home.meet_all([b.slice(lo, hi - lo)])
    if held:
        yield from _Home(held, carry).meet_all(held)


class _Home:
    """Members at home in a part, and where their titles stand."""

    def __init__(self, held: list[pa.RecordBatch], carry: tuple[str, ...]):
        t = pa.Table.from_batches(held)
        column = lambda c: t.column(c).combine_chunks()
        self.key, self.alike, self.carry = column("key"), column("alike"), {c: column(c) for c in carry}
        self.size = pc.list_value_length(t.column("own")).to_numpy().astype(np.int64)
        names = column("own").flatten().dictionary_encode()
        self.titles = names.dictionary
        codes = names.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        order = np.argsort(codes, kind="stable")
        self.holder = np.repeat(np.arange(len(self.size)), self.size)[order]
        self.start = np.searchsorted(codes[order], np.arange(len(self.titles) + 1))
        self.text, self.texts = self._coded(column("text"))

    @staticmethod
    def _coded(texts: pa.Array) -> tuple[np.ndarray, list]:
        """A number for each text, -1 for null, and the texts."""
        coded = texts.dictionary_encode()
        return pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()

    def meet_all(self, batches: list[pa.RecordBatch]):
        rows = max(1, 200_000 // len(self.size))
        for b in batches:
            for lo in range(0, b.num_rows, rows):
                yield self._meet(b.slice(lo, rows))

    def _meet(self, b: pa.RecordBatch) -> pa.RecordBatch:
        n, k = len(self.size), b.num_rows
        shared = np.zeros(n * k, np.int64)
        sizes = {c: pc.list_value_length(b.column(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("own", "more")}
        for c, size in sizes.items():
            code = pc.fill_null(pc.index_in(b.column(c).flatten(), value_set=self.titles), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            of = np.repeat(np.arange(k), size)[code >= 0]
            code = code[code >= 0]
            many = self.start[code + 1] - self.start[code]
            ends = np.cumsum(many)
            lo = 0
            while lo < len(code):  # some millions of meetings at once
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + 4_000_000, "right")))
                reps = many[lo:hi]
                at = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps) + np.repeat(self.start[code[lo:hi]], reps)
                shared += np.bincount(self.holder[at] * k + np.repeat(of[lo:hi], reps), minlength=n * k)
                lo = hi
        text, texts = self._coded(b.column("text"))
        ratio = np.full((len(self.texts) + 1, len(texts) + 1), np.nan)
        for i, x in enumerate(self.texts):
            ratio[i, :-1] = [_ratio(x, y) for y in texts]
        scores = ratio[self.text][:, text].ravel()
        mine = pa.array(np.repeat(np.arange(n), k))
        theirs = pa.array(np.tile(np.arange(k), n))
        arrays = [self.key.take(mine), b.column("key").take(theirs), pa.array(scores, from_pandas=True), self.alike.take(mine), pa.array(np.repeat(self.size, k)), pa.array(np.tile(sizes["own"], n)), pa.array(shared), *(v.take(mine) for v in self.carry.values())]
        return pa.RecordBatch.from_arrays(arrays, ["a", "b", "ratio", "alike", "n_a", "n_b", "shared", *self.carry])


_ratio = functools.lru_cache(1 << 16)(indel)
