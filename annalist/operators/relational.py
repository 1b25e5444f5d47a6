"""Filters, joins, aggregates, windows, sorts and set operations over facts and dimensions. Column names are arguments."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


# --- filters ---------------------------------------------------------------------------------

def split_valid(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Add reason: the first rule that a row breaks, null for good rows."""
    return df.withColumn("reason", F.coalesce(*[F.when(bad, name) for name, bad in rules.items()]))


def text_search(df: DataFrame, cols: Sequence[str], q: str) -> DataFrame:
    """Rows with q, in any case, in one of the columns; wildcards in q stand for themselves."""
    hit = F.lit(False)
    for c in cols:
        hit = hit | F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(q.lower()))
    return df.where(hit)


def facet_filter(df: DataFrame, selected: Mapping[str, Sequence], all_of: Sequence[str] = ()) -> DataFrame:
    """All facets must fit; within one any value, or all of them for the array columns in all_of."""
    for c, values in selected.items():
        wanted = F.array(*[F.lit(v) for v in values])
        df = df.where(F.size(F.array_except(wanted, c)) == 0 if c in all_of else F.arrays_overlap(c, wanted) if df.schema[c].dataType.typeName() == "array" else F.col(c).isin(*values))
    return df


def facet_counts(df: DataFrame, facets: Sequence[str], selected: Mapping[str, Sequence]) -> DataFrame:
    """(facet, value, n): for each facet, rows that pass all the other facets; a selected value stays, with 0 if need be. A row counts for each value of an array column, once."""
    out = None
    for f in facets:
        rest = facet_filter(df, {k: v for k, v in selected.items() if k != f})
        value = F.explode(F.array_distinct(f)) if df.schema[f].dataType.typeName() == "array" else F.col(f)
        part = rest.select(value.alias("value")).select(F.col("value").cast("string")).groupBy("value").agg(F.count(F.lit(1)).alias("n"))
        if selected.get(f):
            part = part.unionByName(df.sparkSession.createDataFrame([(str(v), 0) for v in selected[f]], "value string, n long")).groupBy("value").agg(F.sum("n").alias("n"))
        part = part.select(F.lit(f).alias("facet"), "value", "n")
        out = part if out is None else out.unionByName(part)
    return out


def page(df: DataFrame, order: Sequence[Column], number: int, size: int) -> DataFrame:
    """One page of a stable order."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def paged(df: DataFrame, order: Sequence[Column], number: int, size: int) -> tuple[DataFrame, int, int]:
    """(rows, number, total): a page, its number once it is brought into the range of pages there are, the first being there always, and how many rows there are in all."""
    total = df.count()
    number = max(1, min(number, -(-total // size)))
    return page(df, order, number, size), number, total


# --- joins -----------------------------------------------------------------------------------

def with_activity(dim: DataFrame, facts: Mapping[str, DataFrame], key: str) -> DataFrame:
    """Add the number of rows that each fact table has for the key."""
    for name, fact in facts.items():
        dim = dim.join(fact.groupBy(key).agg(F.count(F.lit(1)).alias(name)), key, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return dim


def played_alongside(df: DataFrame, base: str, actor: str, ts: str, minutes: int = 30, least: int = 2) -> DataFrame:
    """(item, other, n): in how many rows of item another item stands within `minutes` of it for the same actor, if in `least` or more. Rows meet in time buckets as wide as the window, so each looks at three."""
    width = minutes * 60
    s = F.unix_micros(F.col(ts).cast("timestamp")) / 1e6
    left = df.select(F.monotonically_increasing_id().alias("row"), F.col(base).alias("item"), F.col(actor).alias("who"), s.alias("s")).withColumn("b", F.explode(F.sequence(F.floor(F.col("s") / width) - 1, F.floor(F.col("s") / width) + 1)))
    right = df.select(F.col(base).alias("other"), F.col(actor).alias("who"), s.alias("o"), F.floor(s / width).alias("b"))
    near = left.join(right, ["who", "b"]).where((F.col("item") != F.col("other")) & (F.abs(F.col("s") - F.col("o")) <= width))
    return near.groupBy("item", "other").agg(F.countDistinct("row").alias("n")).where(F.col("n") >= least)


def before_after(events: DataFrame, facts: DataFrame, on: str, date: str, ts: str, days: int) -> DataFrame:
    """Add before and after: the entity's facts in the days before an event and from it on. Facts meet events by entity and buckets of `days` days, so an event looks at three of them."""
    bucket = lambda c: F.floor(F.unix_micros(c) / (days * 86_400_000_000))
    keyed = events.withColumn("e_", F.col(date).cast("timestamp"))
    span = F.expr(f"INTERVAL {days} DAYS")
    around = keyed.select(on, "e_").distinct().select("*", F.explode(F.sequence(bucket(F.col("e_")) - 1, bucket(F.col("e_")) + 1)).alias("b_"))
    f = facts.select(F.col(on).alias("f_"), F.col(ts).cast("timestamp").alias("t_")).groupBy("f_", "t_").agg(F.count(F.lit(1)).alias("n_")).withColumn("b2_", bucket(F.col("t_")))
    met = around.join(f, (F.col(on) == F.col("f_")) & (F.col("b_") == F.col("b2_")) & (F.col("t_") >= F.col("e_") - span) & (F.col("t_") < F.col("e_") + span))
    early = F.col("t_") < F.col("e_")
    counts = met.groupBy(F.col(on).alias("on_"), F.col("e_").alias("at_")).agg(F.sum(F.when(early, F.col("n_"))).alias("before"), F.sum(F.when(~early, F.col("n_"))).alias("after"))
    out = keyed.join(counts, (F.col(on) == F.col("on_")) & (F.col("e_") == F.col("at_")), "left")
    return out.select(*events.columns, F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("after", F.lit(0)).alias("after"))


def diff_with_previous(lines: DataFrame, entity: str, event: str, item: str, order: str) -> DataFrame:
    """Per event, how many items are added, kept and dropped against the entity's event before."""
    sets = lines.groupBy(entity, event, order).agg(F.collect_set(item).alias("now"))
    before = F.lag("now").over(Window.partitionBy(entity).orderBy(order, event))
    s = sets.withColumn("was", F.coalesce(before, F.array().cast(sets.schema["now"].dataType)))
    return s.select(entity, event, F.size(F.array_except("now", "was")).cast("long").alias("added"), F.size(F.array_intersect("now", "was")).cast("long").alias("kept"), F.size(F.array_except("was", "now")).cast("long").alias("dropped"))


def links_of(edges: DataFrame, a: str, b: str, order: str) -> DataFrame:
    """Undirected neighbours, each once, by the first link."""
    both = edges.select(F.col(a).alias("node"), F.col(b).alias("other"), F.col(order).alias("first")).union(edges.select(b, a, order))
    return both.groupBy("node", "other").agg(F.min("first").alias("first"))


def first_match(df: DataFrame, lookups: Sequence[tuple[str, DataFrame, str]], value: str) -> DataFrame:
    """Resolve each row by the first lookup that knows it: (rule, lookup with key column and value, key). Adds value and rule."""
    names = []
    for rule, lookup, key in lookups:
        df = df.join(lookup.select(F.col(key), F.col(value).alias(f"v_{rule}")), key, "left")
        names.append(rule)
    found = F.coalesce(*[F.col(f"v_{r}") for r in names])
    rule = F.coalesce(*[F.when(F.col(f"v_{r}").isNotNull(), r) for r in names], F.lit("new"))
    return df.withColumns({value: found, "rule": rule}).drop(*[f"v_{r}" for r in names])


def overlap(df: DataFrame, entity: str, key: str, least: int = 1) -> DataFrame:
    """(a, b, shared, jaccard) of entities that share keys. Keys meet in a join on the key, sizes are joined after it."""
    d = df.select(F.col(entity).alias("e"), F.col(key).alias("k")).distinct()
    n = d.groupBy("e").agg(F.count(F.lit(1)).alias("n"))
    met = d.alias("x").join(d.alias("y"), "k").where("x.e < y.e").groupBy(F.col("x.e").alias("a"), F.col("y.e").alias("b")).agg(F.count(F.lit(1)).alias("shared")).where(F.col("shared") >= least)
    met = met.join(n.select(F.col("e").alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col("e").alias("b"), F.col("n").alias("nb")), "b")
    return met.select("a", "b", "shared", (F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))).alias("jaccard"))


#: Words of 64 bits that stand for a group's members in contained_in().
MASKS = 2


def contained_in(sets: DataFrame, group: str, member: str) -> DataFrame:
    """(small, big): groups all of whose members another group has, equal ones both ways.

    A group meets only the holders of its rarest member, and of these only those that have as many members or more and, in
    a mask of fixed size, every bit of its members; then the members that both have are counted, by joins on group and
    member, so no set is carried whole.
    """
    # Dealt by group, so that members are told apart, counted and masked without another shuffle.
    d = sets.select(F.col(group).alias("g_"), F.col(member).alias("m_")).where("g_ is not null and m_ is not null").repartition("g_").distinct()
    bit = F.pmod(F.xxhash64("m_"), F.lit(64 * MASKS)).cast("int")
    masks = [F.bit_or(F.when(F.floor(bit / 64) == i, F.call_function("shiftleft", F.lit(1).cast("long"), bit % 64)).otherwise(F.lit(0).cast("long"))).alias(f"s{i}_") for i in range(MASKS)]
    size = d.groupBy("g_").agg(F.count(F.lit(1)).alias("n_"), *masks)
    often = d.groupBy("m_").agg(F.count(F.lit(1)).alias("c_"))
    rarest = d.join(often, "m_").groupBy("g_").agg(F.min_by("m_", F.struct("c_", "m_")).alias("m_")).join(size, "g_")
    of = d.join(size, "g_").select(F.col("g_").alias("b_"), "m_", F.col("n_").alias("of_n_"), *[F.col(f"s{i}_").alias(f"of_s{i}_") for i in range(MASKS)])
    within = F.col("n_") <= F.col("of_n_")
    for i in range(MASKS):
        within = within & (F.col(f"s{i}_").bitwiseAND(F.col(f"of_s{i}_")) == F.col(f"s{i}_"))
    pairs = rarest.join(of, "m_").where((F.col("g_") != F.col("b_")) & within).select("g_", "b_", "n_")
    met = pairs.where("n_ > 1").join(d, "g_").join(d.select(F.col("g_").alias("b_"), "m_"), ["b_", "m_"]).groupBy("g_", "b_", "n_").agg(F.count(F.lit(1)).alias("k_")).where("k_ = n_")
    return pairs.where("n_ = 1").select("g_", "b_").unionByName(met.select("g_", "b_")).select(F.col("g_").alias("small"), F.col("b_").alias("big"))


# --- aggregates ------------------------------------------------------------------------------

def most_played(df: DataFrame, key: str, n: int | None = None) -> DataFrame:
    """Rows per key with their share of all and rank, ties sharing it; the first n keys, ties by key. Ranks come from the histogram of counts, so no window sees all keys."""
    per = df.groupBy(key).agg(F.count(F.lit(1)).alias("plays"))
    out = with_rank(per, "plays").join(F.broadcast(per.agg(F.sum("plays").alias("all_"))), how="cross")
    out = out.select(key, "plays", (F.col("plays") / F.col("all_")).alias("share"), "rank")
    return out.orderBy(F.desc("plays"), key).limit(n) if n else out


def with_rank(df: DataFrame, score: str, buckets: int = 256) -> DataFrame:
    """Add rank: one more than the rows with a higher score. Distinct scores are ordered within buckets between quantiles of them, after the sizes of the buckets above; the quantiles set the cost, not the result. Rows without a score have no rank and go."""
    scores = df.where(F.col(score).isNotNull()).groupBy(score).agg(F.count(F.lit(1)).alias("c_"))
    cuts = scores.agg(F.percentile_approx(score, [i / buckets for i in range(1, buckets)]).alias("q_"))
    scores = scores.crossJoin(F.broadcast(cuts)).select(score, "c_", F.size(F.filter("q_", lambda q: q > F.col(score))).alias("b_"))
    above = scores.groupBy("b_").agg(F.sum("c_").alias("s_"))
    above = above.select("b_", F.coalesce(F.sum("s_").over(Window.orderBy("b_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("above_"))
    w = Window.partitionBy("b_").orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, -1)
    ranks = scores.withColumn("r_", F.coalesce(F.sum("c_").over(w), F.lit(0))).join(F.broadcast(above), "b_")
    return df.join(ranks.select(score, (F.col("above_") + F.col("r_") + 1).alias("rank")), score)


def window_pair(df: DataFrame, key: str, ts: str, previous: str, start: str, end: str) -> DataFrame:
    """Counts in [start, end) and [previous, start) in one scan."""
    t = F.col(ts)
    lit = lambda x: F.lit(x).cast(df.schema[ts].dataType)
    return df.where((t >= lit(previous)) & (t < lit(end))).groupBy(key).agg(F.count_if(t >= lit(start)).alias("now"), F.count_if(t < lit(start)).alias("before"))


def rank_moves(df: DataFrame, key: str, ts: str, previous: str, start: str, end: str) -> DataFrame:
    """Competition ranks in a window and the one before, and how each key moved: up, down, same, new or back."""
    pair = window_pair(df, key, ts, previous, start, end)
    first = df.groupBy(key).agg(F.min(ts).alias("first"))
    now = with_rank(pair.where("now > 0"), "now").select(key, "now", F.col("rank").alias("rank_now"))
    was = with_rank(pair.where("before > 0"), "before").select(key, "before", F.col("rank").alias("rank_before"))
    out = now.join(was, key, "left").join(first, key)
    move = F.when(F.col("rank_before").isNull(), F.when(F.col("first") >= F.lit(start).cast(df.schema[ts].dataType), "new").otherwise("back")).when(F.col("rank_now") < F.col("rank_before"), "up").when(F.col("rank_now") > F.col("rank_before"), "down").otherwise("same")
    return out.select(key, F.col("now").alias("plays"), "rank_now", "rank_before", move.alias("move"))


def best_child(facts: DataFrame, parent: str, child: str) -> DataFrame:
    """The child with most rows per parent, ties by the smaller child."""
    per = facts.groupBy(parent, child).agg(F.count(F.lit(1)).alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("m"), F.col(child).alias("child"))).alias("b")
    return per.groupBy(parent).agg(best).select(parent, F.col("b.child").alias("child"), (-F.col("b.m")).alias("n"))


def discovered(df: DataFrame, key: str, ts: str, start: str, end: str) -> DataFrame:
    """Keys whose first row ever lies in [start, end)."""
    t = df.schema[ts].dataType
    return df.groupBy(key).agg(F.min(ts).alias("first"), F.count(F.lit(1)).alias("plays")).where((F.col("first") >= F.lit(start).cast(t)) & (F.col("first") < F.lit(end).cast(t)))


def familiarity(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Histogram of how many times a thing had been met: first, 2-10, 11-49, 50+. It follows from how often each was met, so no thing's rows are put in order."""
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("c_"))
    part = lambda name, lo, hi: F.struct(F.lit(name).alias("bucket"), F.greatest(F.least(F.col("c_"), F.lit(hi)) - lo, F.lit(0)).cast("long").alias("n"))
    sums = n.select(F.inline(F.array(part("first", 0, 1), part("2-10", 1, 10), part("11-49", 10, 49), part("50+", 49, 2**62))))
    return sums.groupBy("bucket").agg(F.sum("n").alias("n")).where("n > 0")


def scaled_total(df: DataFrame, by: str, value: Column, known_least: float = 0.98) -> DataFrame:
    """Sum of a value that some rows lack, scaled up to all rows, and whether it is an estimate."""
    g = df.groupBy(by).agg(F.sum(value).alias("s"), F.count(value).alias("k"), F.count(F.lit(1)).alias("n"))
    return g.select(by, (F.col("s") * F.col("n") / F.col("k")).alias("total"), (F.col("k") < known_least * F.col("n")).alias("estimated"))


# --- windows ---------------------------------------------------------------------------------

def position_role(lines: DataFrame, event: str, pos: str, encore: Column | None = None) -> DataFrame:
    """Add role (opener, closer or middle), of (the lines of the event), nth (the place among them, equal positions in one), and with an encore (a condition on a line) encore, true for lines of one unless all of the event's are."""
    w = Window.partitionBy(event)
    p = F.col(pos)
    out = lines.withColumns({"of": F.count(F.lit(1)).over(w), "nth": F.dense_rank().over(w.orderBy(pos)).cast("long"), "role": F.when(p == F.min(pos).over(w), "opener").when(p == F.max(pos).over(w), "closer").otherwise("middle")})
    return out if encore is None else out.withColumn("encore", F.coalesce(encore, F.lit(False)) & ~F.every(F.coalesce(encore, F.lit(False))).over(w))


def nights(sets: DataFrame, place: str, date: str, lineup: int = 3, alone: int = 5) -> DataFrame:
    """(place, day, sets, kind, of, nth): each day at a place with its number of sets. Days in a row at one place are a festival if one of them has `lineup` sets or more, a single day if it has `alone`; nth and of then say which day of how many it is. Otherwise gigs, without them."""
    days = sets.where(F.col(place).isNotNull() & F.col(date).isNotNull()).groupBy(place, F.col(date).cast("date").alias("day")).agg(F.count(F.lit(1)).alias("sets"))
    w = Window.partitionBy(place).orderBy("day")
    marked = days.withColumn("b_", F.when(F.datediff("day", F.lag("day").over(w)) == 1, 0).otherwise(1)).withColumn("run_", F.sum("b_").over(w))
    run = Window.partitionBy(place, "run_")
    n, most = F.count(F.lit(1)).over(run), F.max("sets").over(run)
    marked = marked.withColumns({"n_": n, "big_": ((n > 1) & (most >= lineup)) | (most >= alone), "k_": F.row_number().over(run.orderBy("day")).cast("long")})
    return marked.select(place, "day", "sets", F.when(F.col("big_"), "festival").otherwise("gig").alias("kind"), F.when(F.col("big_"), F.col("n_")).alias("of"), F.when(F.col("big_"), F.col("k_")).alias("nth"))


def runs(events: DataFrame, place: str, date: str) -> DataFrame:
    """(place, first_day, last_day, days, most): runs of consecutive days at one place, with the most events of a day."""
    days = events.groupBy(place, F.col(date).cast("date").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(place).orderBy("day")
    broken = F.when(F.datediff("day", F.lag("day").over(w)) == 1, 0).otherwise(1)
    marked = days.withColumn("b", broken).withColumn("island", F.sum("b").over(w))
    return marked.groupBy(place, "island").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count(F.lit(1)).alias("days"), F.max("n").alias("most")).drop("island")


def longest_gap(df: DataFrame, key: str, date: str) -> DataFrame:
    """The longest time in days between two dates of a key, and when it began."""
    d = df.select(key, F.col(date).cast("date").alias("d")).distinct()
    g = d.withColumn("p", F.lag("d").over(Window.partitionBy(key).orderBy("d"))).where("p is not null").withColumn("gap", F.datediff("d", "p").cast("long"))
    return g.groupBy(key).agg(F.max(F.struct("gap", (-F.unix_date("p")).alias("o"))).alias("m")).select(key, F.col("m.gap").alias("gap"), F.date_from_unix_date((-F.col("m.o")).cast("int")).alias("since"))


def nth_occurrence(df: DataFrame, by: Sequence[str], order: Sequence[Column], wanted: Sequence[int] = ()) -> DataFrame:
    """Add nth: how many rows of the same item there are up to this one; only the wanted ones, if any are named."""
    out = df.withColumn("nth", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long"))
    return out.where(F.col("nth").isin(*wanted)) if wanted else out


def group_listing(df: DataFrame, key: str, order: Sequence[Column], by: str = "size", unknown: str = "Unknown") -> DataFrame:
    """Rows in groups, the largest first (by "size") or in the order of their key (by "key"), rows of no group last; group says which, and rows within one keep the order."""
    size = df.groupBy(key).agg(F.count(F.lit(1)).alias("size_"))
    first = [F.desc("size_")] if by == "size" else []
    return df.join(size, key, "left").orderBy(F.col(key).isNull(), *first, key, *order).withColumn("group", F.coalesce(F.col(key).cast("string"), F.lit(unknown))).drop("size_")


def exact_groups(df: DataFrame, by: Sequence[str], key: str, dismissed: DataFrame | None = None, camp: Column | None = None) -> DataFrame:
    """(by, key, first, n): members of groups of two or more, a row each, under the smallest. A member that dismissed pairs (a, b) set apart from all others of its group is none of it.

    camp stands for dismissals by kind, without their pairs: every two keys of a group with different camps were dismissed, a key without one never.
    """
    out = df.select(*by, key).distinct()
    if camp is not None:
        held = df.select(*by, key, camp.alias("camp_")).distinct()
        of = held.groupBy(*by, "camp_").agg(F.count(F.lit(1)).alias("c_"))
        all_ = of.groupBy(*by).agg(F.sum("c_").alias("n_"), F.sum(F.when(F.col("camp_").isNotNull(), F.col("c_"))).alias("k_"))
        apart = of.join(all_, list(by)).where((F.col("n_") > 1) & (F.col("k_") - F.col("c_") == F.col("n_") - 1) & F.col("camp_").isNotNull()).select(*by, "camp_")
        out = held.join(apart, [*by, "camp_"], "left_anti").select(*by, key)
    size = lambda d: d.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first")).where("n > 1")
    groups = size(out)
    met = out.join(groups, list(by))
    if dismissed is None:
        return met
    pairs = dismissed.select("a", "b").union(dismissed.select("b", "a")).toDF("x_", "y_").where("x_ <> y_").distinct()
    apart = met.select(*by, F.col(key).alias("x_"), "n").join(pairs, "x_").join(met.select(*by, F.col(key).alias("y_")), [*by, "y_"]).groupBy(*by, "x_", "n").agg(F.count(F.lit(1)).alias("m_")).where("m_ = n - 1").select(*by, F.col("x_").alias(key))
    left = out.join(apart, [*by, key], "left_anti")
    return left.join(size(left), list(by))


def referential_checks(tables: Mapping[str, DataFrame], refs: Sequence[tuple[str, str, str, str, str]]) -> DataFrame:
    """(check, n): for each reference (name, table, column, dimension, its key) the rows whose value no row of the dimension has; null values refer to nothing."""
    out = None
    for name, table, column, dim, key in refs:
        one = tables[table].where(F.col(column).isNotNull()).select(F.col(column).alias("k_")).join(tables[dim].select(F.col(key).alias("k_")).distinct(), "k_", "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("check"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def activity(histories: Mapping[str, DataFrame], n: int) -> DataFrame:
    """(id, kind, at): the newest n entries of several histories (id, at), ties by kind and id."""
    out = None
    for kind, df in histories.items():
        one = df.select("id", F.lit(kind).alias("kind"), "at")
        out = one if out is None else out.unionByName(one)
    return out.orderBy(F.desc("at"), "kind", "id").limit(n)


def pick_tags(votes: DataFrame, entity: str, tag: str, least: int = 2, tiebreak: Sequence[Column] = ()) -> DataFrame:
    """Of votes (entity, tag, votes) the tags with `least` or more; for an entity without any, the one with most, ties by the tiebreak, then by tag."""
    nth = F.row_number().over(Window.partitionBy(entity).orderBy(F.desc("votes"), *tiebreak, tag))
    top = F.max("votes").over(Window.partitionBy(entity))
    return votes.withColumns({"nth_": nth, "top_": top}).where((F.col("votes") >= least) | ((F.col("top_") < least) & (F.col("nth_") == 1))).drop("nth_", "top_")


def main_tag_mix(plays: DataFrame, tags: DataFrame, entity: str, tag: str, order: Sequence[Column]) -> DataFrame:
    """(tag, plays): plays (entity, plays) by each entity's main tag, the first of its tags in the order, ties by tag."""
    main = tags.withColumn("nth_", F.row_number().over(Window.partitionBy(entity).orderBy(*order, tag))).where("nth_ = 1").select(entity, F.col(tag).alias("tag"))
    return plays.groupBy(entity).agg(F.sum("plays").alias("plays")).join(main, entity).groupBy("tag").agg(F.sum("plays").alias("plays"))


def top_per_group(df: DataFrame, by: str, order: Sequence[Column], k: int) -> DataFrame:
    return df.withColumn("nth", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("nth") <= k)


def split_runs(df: DataFrame, group: str, order: str, key: str) -> DataFrame:
    """Add run: a number that goes up whenever the key changes."""
    w = Window.partitionBy(group).orderBy(order)
    return df.withColumn("c_", F.when(F.col(key).eqNullSafe(F.lag(key).over(w)) & F.lag(order).over(w).isNotNull(), 0).otherwise(1)).withColumn("run", F.sum("c_").over(w)).drop("c_")


def sample_by_hash(df: DataFrame, key: str, seed: str, n: int) -> DataFrame:
    """The same n rows each time."""
    return df.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(seed))), key).limit(n)


# --- small filters and joins -----------------------------------------------------------------

def flag_values(df: DataFrame, col: str, values: Sequence[str], name: str = "flagged") -> DataFrame:
    """Add whether a text, trimmed and in lower case, is one of the values; null: false."""
    return df.withColumn(name, F.coalesce(F.trim(F.lower(col)).isin(*[v.lower() for v in values]), F.lit(False)))


def min_length(df: DataFrame, cols: Sequence[str], n: int) -> DataFrame:
    """Rows all of whose texts have n characters or more; null: too short."""
    keep = F.lit(True)
    for c in cols:
        keep = keep & (F.length(c) >= n)
    return df.where(keep)


def exclude_values(df: DataFrame, col: str, values: Sequence, other: str | None = None) -> DataFrame:
    """Rows whose value is none of the listed ones, nor that of the column `other`. Null is no listed value."""
    out = df.where(~F.coalesce(F.col(col).isin(*values), F.lit(False)))
    return out.where(~F.col(col).eqNullSafe(F.col(other))) if other else out


def where_exists(df: DataFrame, other: DataFrame, on: Sequence[str] | str) -> DataFrame:
    """Rows that another table has a row for."""
    return df.join(other.select(*([on] if isinstance(on, str) else on)), on, "left_semi")


def where_missing(df: DataFrame, other: DataFrame, on: Sequence[str] | str) -> DataFrame:
    """Rows that another table has no row for; null keys have none."""
    return df.join(other.select(*([on] if isinstance(on, str) else on)), on, "left_anti")


def valid_id(df: DataFrame, col: str, pattern: str = "[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}", name: str = "valid") -> DataFrame:
    """Add whether an external id, in lower case, has the shape (of a UUID); null: false."""
    return df.withColumn(name, F.coalesce(F.lower(F.trim(col)).rlike(f"^({pattern})$"), F.lit(False)))


def expand_scope(df: DataFrame, parts: DataFrame, col: str, whole: str, part: str) -> DataFrame:
    """Add scope: a row for the thing itself and one for each of its parts, one level deep."""
    both = df.select(F.col(col).alias("w_"), F.col(col).alias("scope")).union(parts.select(whole, part)).distinct()
    return df.join(both, df[col] == F.col("w_")).drop("w_")


def credited(df: DataFrame, bridge: DataFrame, item: str, primary: str, actor: str) -> DataFrame:
    """(item, actor): the primary actor of an item and all that a bridge credits, each once."""
    return df.select(item, F.col(primary).alias(actor)).union(bridge.select(item, actor)).where(F.col(actor).isNotNull()).distinct()


def star(fact: DataFrame, dims: Sequence[tuple[DataFrame, str, str]], how: str = "inner") -> DataFrame:
    """Facts with their dimensions: (dimension, fact's column, dimension's key). A dimension is broadcast only where Spark knows it to be small."""
    for dim, mine, key in dims:
        fact = fact.join(dim, fact[mine] == dim[key], how)
    return fact


def weight(df: DataFrame, factors: dict[str, float], name: str = "weight") -> DataFrame:
    """Add the sum of columns times factors; null counts as nothing."""
    total = F.lit(0)
    for c, k in factors.items():
        total = total + F.coalesce(F.col(c), F.lit(0)) * k
    return df.withColumn(name, total)


def rollup_tags(item_tags: DataFrame, credits: DataFrame, item: str, actor: str, tag: str, fallback: DataFrame) -> DataFrame:
    """(actor, tag, items): tags of an actor's items with how many carry each; for actors without any, the fallback's (actor, tag), with 0."""
    own = credits.select(item, actor).distinct().join(item_tags.select(item, tag).distinct(), item).groupBy(actor, tag).agg(F.countDistinct(item).alias("items"))
    rest = fallback.select(actor, tag).distinct().join(own.select(actor).distinct(), actor, "left_anti").withColumn("items", F.lit(0).cast("long"))
    return own.unionByName(rest)


def sort_key(columns: Sequence[tuple[str, bool, object]]) -> list[Column]:
    """Sort columns of (name, descending, stand-in for null), to be flipped as one."""
    return [(F.coalesce(F.col(c), F.lit(x)).desc() if down else F.coalesce(F.col(c), F.lit(x)).asc()) for c, down, x in columns]


def order_tiers(df: DataFrame, tier: str, confidence: str, tiers: Sequence[str] = ("high", "medium", "low")) -> DataFrame:
    """Add place: the tier's, unknown ones last; rows are meant to be sorted by it, then by confidence, highest first."""
    place = F.coalesce(*[F.when(F.col(tier) == t, i) for i, t in enumerate(tiers)], F.lit(len(tiers)))
    return df.withColumn("place", place).orderBy("place", F.desc(confidence))


def best_list(lists: DataFrame, group: str, original: str, lines: str, year: str) -> DataFrame:
    """One list a group: an original issue before others, then the one with most lines, then the earliest, then the smallest id."""
    order = F.struct((~F.coalesce(F.col(original), F.lit(False))).alias("o"), (-F.col(lines)).alias("l"), F.coalesce(year, F.lit(9999)).alias("y"), F.col("list").alias("i"))
    return lists.groupBy(group).agg(F.min_by("list", order).alias("list"))
