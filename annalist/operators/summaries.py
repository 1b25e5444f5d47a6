"""Summaries by entity and the pages made of them. Every page is computed for all entities at once, keyed by entity."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annalist.functions import inventory, times
from annalist.operators import relational as R


def rows() -> Column:
    return F.count(F.lit(1))


def first_last(df: DataFrame, key: str, ts: str) -> DataFrame:
    """(key, n, first, last)."""
    return df.groupBy(key).agg(rows().alias("n"), F.min(ts).alias("first"), F.max(ts).alias("last"))


#: Periods up to this number are broadcast, a row of some 40 bytes each.
MOST_PERIODS = 10_000


def distinct_counts(df: DataFrame, by: Sequence[str], cols: Sequence[str], approx: bool = False) -> DataFrame:
    """Rows and distinct values of several columns in one pass, exact or by sketches."""
    count = F.approx_count_distinct if approx else F.countDistinct
    return df.groupBy(*by).agg(rows().alias("n"), *[count(c).alias(f"n_{c}") for c in cols])


def daily_sketches(df: DataFrame, ts: str, cols: Sequence[str], by: Sequence[str] = (), bits: int = 14) -> DataFrame:
    """(by, day, n, <col>...): rows of each day and a sketch of each column's distinct values, of 2 ** bits bytes at most. Sketches of any days can be merged, so a period's distinct counts need not read its rows. Null values don't count."""
    return df.groupBy(*by, F.to_date(ts).alias("day")).agg(rows().alias("n"), *[F.hll_sketch_agg(F.col(c).cast("string"), bits).alias(c) for c in cols])


def period_counts(sketches: DataFrame, periods: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by, period, n, n_<col>...) for periods (period, start, end; end exclusive) that may overlap, from daily sketches. Distinct counts are estimates, with a relative error of about 1.04 / sqrt(2 ** bits): under 1 % for 14 bits. A period without days: no row."""
    met = sketches.join(F.broadcast(periods), (F.col("day") >= F.col("start")) & (F.col("day") < F.col("end"))) if periods.count() <= MOST_PERIODS else sketches.join(periods.select("period", F.explode(F.sequence("start", F.date_sub("end", 1))).alias("day")), "day")
    return met.groupBy(*by, "period").agg(F.sum("n").alias("n"), *[F.hll_sketch_estimate(F.hll_union_agg(c)).alias(f"n_{c}") for c in cols])


def matrix(facts: DataFrame, parent: str, item: str, show: str, ts: str, most: int = 24) -> DataFrame:
    """(parent, item, kind, cells): how often each of a parent's items was met, at each of its shows if there are `most` at most, else in each year; cells (at, n) in the order of time, without those of none.

    Shows are told apart by time, then key. One pass over the facts: the number of columns of a parent decides after both
    have been counted. A parent with more years than `most` has them all: they are few.
    """
    n = facts.groupBy(parent, item, show, F.year(ts).alias("year")).agg(rows().alias("n"), F.min(ts).alias("first_"))
    shows = n.groupBy(parent, show).agg(F.min("first_").alias("at_"))
    few = shows.groupBy(parent).agg(rows().alias("shows_"))
    # A parent of at most `most` shows has as many cells an item; the others one for each year.
    small = n.join(few.where(F.col("shows_") <= most), parent).join(shows, [parent, show]).groupBy(parent, item, F.col(show).cast("string").alias("at"), "at_").agg(F.sum("n").alias("n")).select(parent, item, F.lit("show").alias("kind"), "at", F.struct("at_", "at").alias("o_"), "n")
    large = n.join(few.where(F.col("shows_") > most), parent).groupBy(parent, item, "year").agg(F.sum("n").alias("n")).select(parent, item, F.lit("year").alias("kind"), F.col("year").cast("string").alias("at"), F.struct(F.make_date("year", F.lit(1), F.lit(1)).cast(facts.schema[ts].dataType).alias("at_"), F.col("year").cast("string").alias("at")).alias("o_"), "n")
    cells = F.transform(F.array_sort(F.collect_list(F.struct("o_", "at", "n"))), lambda x: F.struct(x["at"].alias("at"), x["n"].alias("n")))
    return small.unionByName(large).groupBy(parent, item, "kind").agg(cells.alias("cells"))


def having(df: DataFrame, by: Sequence[str], aggregates: Mapping[str, Column], keep: str) -> DataFrame:
    """Groups whose aggregates pass a condition on them."""
    return df.groupBy(*by).agg(*[a.alias(n) for n, a in aggregates.items()]).where(keep)


def spellings(df: DataFrame, key: str, text: str, k: int = 4) -> DataFrame:
    """(key, spellings): the k most frequent texts of a key, ties by text."""
    n = df.where(F.col(text).isNotNull()).groupBy(key, text).agg(rows().alias("n_"))
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n_")).alias("m"), F.col(text).alias("t")))), 1, k)
    return n.groupBy(key).agg(F.transform(best, lambda x: x["t"]).alias("spellings"))


def join_values(df: DataFrame, by: str, col: str, sep: str = ", ") -> DataFrame:
    """Distinct values of a group, sorted, in one text."""
    return df.groupBy(by).agg(F.array_join(F.array_sort(F.collect_set(F.col(col).cast("string"))), sep).alias("values"))


def tally(df: DataFrame, col: Column, order: Sequence[str] = ()) -> DataFrame:
    """(value, n, place): how often each value occurs and where it stands in its natural order; values not listed come after, null last."""
    n = df.groupBy(col.cast("string").alias("value")).agg(rows().alias("n"))
    listed = F.coalesce(*[F.when(F.col("value") == v, i) for i, v in enumerate(order)], F.when(F.col("value").isNull(), len(order) + 1), F.lit(len(order)))
    return n.withColumn("place", listed)


def totals(named: Mapping[str, tuple[DataFrame, Column]]) -> DataFrame:
    """One row of one figure a table."""
    out = None
    for name, (df, figure) in named.items():
        one = df.agg(figure.alias(name))
        out = one if out is None else out.crossJoin(one)  # one row each
    return out


def coverage(df: DataFrame, by: str, known: Column, pending: Column) -> DataFrame:
    """(by, known, pending, n, percent known)."""
    return df.groupBy(by).agg(F.count_if(known).alias("known"), F.count_if(pending & ~known).alias("pending"), rows().alias("n"), F.round(100 * F.count_if(known) / rows(), 1).alias("percent"))


def neighbours(df: DataFrame, entity: str, order: Sequence[str], value: str) -> DataFrame:
    """Add previous and next: the value of the entity's rows before and after."""
    w = Window.partitionBy(entity).orderBy(*order)
    return df.withColumns({"previous": F.lag(value).over(w), "next": F.lead(value).over(w)})


def nth_of(df: DataFrame, entity: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Add nth and of: the how manieth of how many rows of its entity a row is."""
    return df.withColumns({"nth": F.row_number().over(Window.partitionBy(*entity).orderBy(*order)), "of": F.count(F.lit(1)).over(Window.partitionBy(*entity))})


def with_stats(df: DataFrame, facts: DataFrame, on: str, date: str, ts: str) -> DataFrame:
    """Add facts_until: how many of the entity's facts lie on or before a row's date. Both sides go through one running count, so no row meets all facts."""
    day = F.col(ts).cast("date")
    n = facts.groupBy(on, day.alias("d_")).agg(rows().alias("n_"))
    asked = df.select(on, F.col(date).cast("date").alias("d_")).distinct().withColumn("n_", F.lit(0).cast("long"))
    each = n.unionByName(asked).groupBy(on, "d_").agg(F.sum("n_").alias("n_"))
    run = each.withColumn("facts_until", F.sum("n_").over(Window.partitionBy(on).orderBy("d_"))).select(F.col(on).alias("o_"), "d_", "facts_until")
    return df.join(run, df[on].eqNullSafe(run["o_"]) & df[date].cast("date").eqNullSafe(run["d_"]), "left").drop("o_", "d_")


def since_first(events: DataFrame, facts: DataFrame, on: str, date: str, ts: str) -> DataFrame:
    """(on, first, before, since): the entity's facts before its first event and from it on."""
    first = events.groupBy(on).agg(F.min(F.col(date).cast("date")).alias("first"))
    day = F.col(ts).cast("date")
    return facts.select(on, ts).join(first, on).groupBy(on, "first").agg(F.count_if(day < F.col("first")).alias("before"), F.count_if(day >= F.col("first")).alias("since"))


def diverse_top(df: DataFrame, group: str, score: str, key: str, k: int) -> DataFrame:
    """The k rows of highest score, one a group at most; ties by key."""
    best = df.groupBy(group).agg(F.max_by(F.struct(score, key), F.struct(score, -F.col(key))).alias("b_"))
    return best.select(group, f"b_.{score}", f"b_.{key}").orderBy(F.desc(score), key).limit(k)


def tag_weights(tags: DataFrame, item: str, tag: str) -> DataFrame:
    """(tag, weight): the logarithm of one and the number of items a carrier."""
    n = tags.agg(F.countDistinct(item).alias("n_"))
    df = tags.groupBy(tag).agg(F.countDistinct(item).alias("c_"))
    return df.crossJoin(F.broadcast(n)).select(tag, F.log1p(F.col("n_") / F.col("c_")).alias("weight"))  # one row


# --- pages -----------------------------------------------------------------------------------

def overview(plays: DataFrame, key: str, actor: str, ts: str, as_of: str, days: int = 30) -> DataFrame:
    """One row: plays, actors, items, plays of the last days and items first met in them."""
    end = F.lit(as_of).cast(plays.schema[ts].dataType)
    start = end - F.expr(f"INTERVAL {days} DAYS")
    recent = (F.col(ts) >= start) & (F.col(ts) < end)
    first = plays.groupBy(key).agg(F.min(ts).alias(ts))
    return totals({"plays": (plays, rows()), "actors": (plays, F.countDistinct(actor)), "items": (first, rows()), "recent": (plays, F.count_if(recent)), "discovered": (first, F.count_if(recent))})


def activity_report(plays: DataFrame, key: str, actor: str, ts: str, start: str, end: str) -> DataFrame:
    """(part, bucket, n) of a period: plays by day without gaps, by hour and by weekday, and figures: plays, items, actors, new items."""
    p = times.in_period(plays, ts, start, end)
    by = lambda part, c: p.groupBy(c.cast("string").alias("bucket")).agg(rows().alias("n")).select(F.lit(part).alias("part"), "bucket", "n")
    days = plays.sparkSession.sql(f"SELECT explode(sequence(DATE '{start}', DATE '{end}' - INTERVAL 1 DAY)) AS d_").select(F.col("d_").cast("string").alias("bucket"))
    seen = by("day", F.col(ts).cast("date"))
    filled = days.join(seen.select("bucket", "n"), "bucket", "left").select(F.lit("day").alias("part"), "bucket", F.coalesce("n", F.lit(0)).alias("n"))
    figures = totals({"plays": (p, rows()), "items": (p, F.countDistinct(key)), "actors": (p, F.countDistinct(actor)), "new": (R.discovered(plays, key, ts, start, end), rows())})
    shown = figures.select(F.inline(F.array(*[F.struct(F.lit("figure").alias("part"), F.lit(c).alias("bucket"), F.col(c).alias("n")) for c in figures.columns])))
    return filled.unionByName(by("hour", F.hour(ts))).unionByName(by("weekday", F.weekday(ts))).unionByName(shown)


def browse_plays(plays: DataFrame, cols: Sequence[str], q: str, ts: str, start: str, end: str, key: str, number: int, size: int) -> DataFrame:
    """A page of the plays of a period that hold a text, newest first."""
    return R.page(R.text_search(times.in_period(plays, ts, start, end), cols, q), [F.desc(ts), F.asc(key)], number, size)


def browse_entities(plays: DataFrame, key: str, ts: str, previous: str, start: str, end: str) -> DataFrame:
    """Entities played in a window: plays, plays in the window before, first and last ever, rank and move, all-time plays and rank."""
    moves = R.rank_moves(plays, key, ts, previous, start, end)
    ever = R.with_rank(first_last(plays, key, ts).withColumnRenamed("n", "ever"), "ever").withColumnRenamed("rank", "rank_ever")
    return moves.join(ever, key)


def entity_pages(plays: DataFrame, entity: str, child: str, ts: str) -> DataFrame:
    """A row an entity: plays, first, last, children, rank, share of all plays, the child most played and its plays."""
    base = R.with_rank(first_last(plays, entity, ts), "n")
    children = plays.groupBy(entity).agg(F.countDistinct(child).alias("children"))
    best = R.best_child(plays, entity, child).select(entity, F.col("child").alias("best"), F.col("n").alias("best_n"))
    all_ = plays.agg(rows().alias("all_"))
    out = base.join(children, entity).join(best, entity).crossJoin(F.broadcast(all_))  # one row
    return out.withColumn("share", F.col("n") / F.col("all_")).drop("all_")


def item_pages(plays: DataFrame, items: DataFrame, item: str, key: str, ts: str) -> DataFrame:
    """A row an item: plays, first, last, the hour most played in, and how many rows share its key and their plays together."""
    p = first_last(plays, item, ts)
    hours = plays.groupBy(item, F.hour(ts).alias("h_")).agg(rows().alias("c_")).groupBy(item).agg(F.max_by("h_", F.struct("c_", -F.col("h_"))).alias("hour"))
    met = items.select(item, key).join(p, item, "left").join(hours, item, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    versions = met.groupBy(key).agg(rows().alias("versions"), F.sum("n").alias("all_plays"))
    return met.join(versions, key)


def inventory_records(copies: DataFrame, key: str, format_: str, condition: str, kind: str, pressed: str, album: str) -> DataFrame:
    """A row a copy: media, discs, reissue, original year and its decade, grade and its score."""
    f = copies.withColumn("f_", inventory.parse_format(F.col(format_))).withColumn("y_", inventory.pressing_years(F.col(kind), F.col(pressed), F.col(album), F.col("f_.reissue"))).withColumn("g_", inventory.grade(F.col(condition)))
    return f.select(key, "f_.media", "f_.discs", F.col("y_.reissue").alias("reissue"), F.col("y_.year").alias("year"), inventory.decade(F.col("y_.year")).alias("decade"), F.col("g_.short").alias("grade"), F.col("g_.score").alias("score"))


def event_hub(events: DataFrame, place: str, actor: str, date: str) -> DataFrame:
    """A row a place: events, actors, first, last and the longest run of days."""
    base = first_last(events, place, date).join(events.groupBy(place).agg(F.countDistinct(actor).alias("actors")), place)
    longest = R.runs(events, place, date).groupBy(place).agg(F.max("days").alias("longest_run"))
    return base.join(longest, place)


def event_insights(events: DataFrame, facts: DataFrame, actor: str, date: str, ts: str) -> DataFrame:
    """A row an actor seen: times, first, last, and plays before the first time and since."""
    seen = first_last(events.select(actor, F.col(date).cast("date").alias("d_")), actor, "d_")
    split = since_first(events, facts, actor, date, ts).select(actor, "before", "since")
    return seen.join(split, actor, "left").select(actor, "n", "first", "last", F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("since", F.lit(0)).alias("since"))


def event_pages(events: DataFrame, event: str, actor: str, place: str, date: str) -> DataFrame:
    """A row an event: the how manieth of its actor, the how manieth of its actor at its place, and the actor's event before."""
    order = [date, event]
    out = neighbours(nth_of(events.select(event, actor, place, date), [actor], order), actor, order, event)
    there = nth_of(events.select(event, actor, place, date), [actor, place], order).select(F.col(event).alias("e_"), F.col("nth").alias("nth_there"))
    return out.join(there, out[event] == there["e_"]).drop("e_")


def evidence_todo(actors: DataFrame, caches: Mapping[str, DataFrame], key: str) -> DataFrame:
    """(step, key): actors whose evidence of a kind is still to look up; caches are keyed like actors."""
    out = None
    for step, cache in caches.items():
        one = R.where_missing(actors.select(key).distinct(), cache, key).select(F.lit(step).alias("step"), key)
        out = one if out is None else out.unionByName(one)
    return out


def best_child_in(facts: DataFrame, parent: str, child: str, ts: str, start: str, end: str) -> DataFrame:
    """(parent, child, n, ever): the child most played in a period, or of all time for parents without plays in it; n is of whichever counted."""
    now = R.best_child(times.in_period(facts, ts, start, end), parent, child).withColumn("ever", F.lit(False))
    ever = R.best_child(facts, parent, child).join(now.select(parent), parent, "left_anti").withColumn("ever", F.lit(True))
    return now.unionByName(ever)


def rank_bands(plays: DataFrame, key: str, ts: str, bands: Sequence[int] = (1, 3, 10)) -> DataFrame:
    """(key, year, n, band): an entity's plays of every year from its first to the last of all, and the band its rank in that year falls in; 0 plays and no band where there are none."""
    n = plays.groupBy(key, F.year(ts).alias("year")).agg(rows().alias("n"))
    counts = n.groupBy("year", "n").agg(rows().alias("ties_"))
    above = F.coalesce(F.sum("ties_").over(Window.partitionBy("year").orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = n.join(counts.select("year", "n", (above + 1).alias("rank_")), ["year", "n"])
    last = n.agg(F.max("year").alias("last_"))
    spine = n.groupBy(key).agg(F.min("year").alias("first_")).crossJoin(F.broadcast(last)).select(key, F.explode(F.sequence("first_", "last_")).alias("year"))  # one row
    band = F.coalesce(*[F.when(F.col("rank_") <= b, b) for b in bands])
    return spine.join(ranked, [key, "year"], "left").select(key, "year", F.coalesce("n", F.lit(0)).alias("n"), band.alias("band"))
