"""Resolving sightings to entities, near duplicates, placement and review queues. Bulk jobs over whole tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annalist.functions.text import fold, name_key

#: Buckets that number rows in parallel; one row for each of them is broadcast.
BUCKETS = 1024


# --- resolving -------------------------------------------------------------------------------

def numbered(df: DataFrame, key: str, name: str, start: Column | int = 1) -> DataFrame:
    """Distinct keys with consecutive numbers. Each bucket of keys is numbered by itself, after the sizes of the buckets before it."""
    keys = df.select(key).distinct().withColumn("b_", F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int"))
    sizes = keys.groupBy("b_").agg(F.count(F.lit(1)).alias("n_"))
    before = sizes.select("b_", F.coalesce(F.sum("n_").over(Window.orderBy("b_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before_"))
    nth = F.row_number().over(Window.partitionBy("b_").orderBy(key)) - 1
    start = F.lit(start) if isinstance(start, int) else start
    return keys.withColumn("nth_", nth).join(F.broadcast(before), "b_").select(key, (start + F.col("before_") + F.col("nth_")).alias(name))


def resolve(sightings: DataFrame, dim: DataFrame, aliases: DataFrame, key: str, ext: str, name: str) -> DataFrame:
    """Add entity and how. The first that fits wins: an alias of the name, the external id, the name's key. Else the entity is new: one number for each new name key, after the largest in use.

    dim (entity, ext, name), aliases (alias, entity). Of several entities with one key the smallest counts. A sighting without a name and without a known id stays without an entity."""
    s = sightings.withColumns({"a_": F.lower(F.trim(name)), "k_": name_key(F.col(name))})
    one = lambda df, k, e: df.where(F.col("x_").isNotNull() & (F.col("x_").cast("string") != "")).groupBy(F.col("x_").alias(k)).agg(F.min("entity").alias(e))
    met = s.join(one(aliases.select(F.lower(F.trim("alias")).alias("x_"), "entity"), "a_", "e1_"), "a_", "left")
    met = met.join(one(dim.select(F.col(ext).alias("x_"), "entity"), ext, "e2_"), ext, "left")
    met = met.join(one(dim.select(name_key(F.col(name)).alias("x_"), "entity"), "k_", "e3_"), "k_", "left")
    how = F.when(F.col("e1_").isNotNull(), "alias").when(F.col("e2_").isNotNull(), "id").when(F.col("e3_").isNotNull(), "name").when(F.col("k_") != "", "new")
    met = met.withColumns({"how": how, "known_": F.coalesce("e1_", "e2_", "e3_")})
    top = F.broadcast(dim.agg(F.coalesce(F.max("entity"), F.lit(0)).alias("top_")))
    new = numbered(met.where("how = 'new'"), "k_", "nth_").crossJoin(top).select("k_", (F.col("top_") + F.col("nth_")).alias("new_"))
    return met.join(new, "k_", "left").select(*sightings.columns, F.coalesce("known_", F.when(F.col("how") == "new", F.col("new_"))).alias("entity"), "how")


def id_sets(dim: DataFrame, aliases: DataFrame, key: str, ext: str) -> DataFrame:
    """(key, ids): every external id that stands for an entity, its own and its aliases', sorted."""
    return dim.select(key, ext).unionByName(aliases.select(key, ext)).where(F.col(ext).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_set(ext)).alias("ids"))


def backfill_ids(dim: DataFrame, claims: DataFrame, key: str, ext: str) -> DataFrame:
    """Claims with outcome: filled (the entity has no id, nobody has this one, and this claimant is the first), same, or clash."""
    mine = dim.select(key, F.col(ext).alias("mine_"))
    held = dim.where(F.col(ext).isNotNull()).select(ext).distinct().withColumn("held_", F.lit(True))
    met = claims.select(key, ext).distinct().join(mine, key).join(held, ext, "left")
    free = F.col("held_").isNull() & F.col("mine_").isNull()
    by_id, by_key = Window.partitionBy(ext, free.cast("int")).orderBy(key), Window.partitionBy(key, free.cast("int")).orderBy(ext)
    met = met.withColumns({"p_": F.row_number().over(by_id), "q_": F.row_number().over(by_key)})
    outcome = F.when(F.col("mine_").eqNullSafe(F.col(ext)), "same").when(free & (F.col("p_") == 1) & (F.col("q_") == 1), "filled").otherwise("clash")
    return met.select(key, ext, outcome.alias("outcome"))


def record_findings(found: DataFrame, open_: DataFrame, keys: Sequence[str], informational: Sequence[str]) -> DataFrame:
    """Findings worth recording: each once, none that is open already; settled is true for kinds that only inform."""
    return found.dropDuplicates(list(keys)).join(open_.select(*keys).distinct(), list(keys), "left_anti").withColumn("settled", F.col("kind").isin(*informational))


def classify_ids(seen: DataFrame, tracklists: DataFrame, direct: DataFrame, key: str, context: str) -> DataFrame:
    """(key, kind): what an ambiguous id is. slot if a tracklist it was seen with lists it so, item if it is listed as an item, else what a direct look-up says, else unknown. tracklists (context, key, kind), direct (key, kind)."""
    by_list = seen.select(key, context).distinct().join(tracklists, [key, context]).groupBy(key).agg(F.max("kind").alias("listed_"))
    said = direct.groupBy(key).agg(F.min("kind").alias("said_"))
    return seen.select(key).distinct().join(by_list, key, "left").join(said, key, "left").select(key, F.coalesce("listed_", "said_", F.lit("unknown")).alias("kind"))


def settle(findings: DataFrame, live: DataFrame, key: str, now: str, theirs: str) -> DataFrame:
    """Open findings with state: gone (their subject is no more), agrees (its value is now what the source says) or open. live (key, now)."""
    met = findings.join(live.select(key, F.col(now).alias("now_"), F.lit(True).alias("in_")), key, "left")
    return met.select(*findings.columns, F.when(F.col("in_").isNull(), "gone").when(F.col("now_").eqNullSafe(F.col(theirs)), "agrees").otherwise("open").alias("state"))


def upsert_suggestions(existing: DataFrame, new: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Suggestions (keys, value, status): decided rows stay as they are, open ones take the new value, pairs not seen yet come in as open."""
    met = existing.join(new.select(*keys, F.col(value).alias("new_")), list(keys), "full")
    open_ = F.coalesce(F.col("status"), F.lit("open")) == "open"
    return met.select(*keys, F.when(open_, F.coalesce("new_", value)).otherwise(F.col(value)).alias(value), F.coalesce("status", F.lit("open")).alias("status"))


# --- near duplicates -------------------------------------------------------------------------

def near_pairs(df: DataFrame, key: str, text: str, percent: int, block: str | None = None, dismissed: DataFrame | None = None) -> DataFrame:
    """(a, b, block, similarity): pairs of different texts of a block whose Levenshtein similarity is percent/100 or more, each text once under its smallest key. No pair of `dismissed` (a, b) comes back.

    An edit changes two bigrams at most, so two texts k edits apart share one of their rarest 2k+1. Only texts that share such a bigram are compared: neither a block nor the table is paired with itself. percent is 67 or more; below that there may be no shared bigram."""
    assert 67 <= percent <= 100
    block_ = F.col(block) if block else F.lit("")
    t = df.where(F.col(text).isNotNull() & (F.col(text) != "")).groupBy(block_.alias("block"), F.col(text).alias("text_")).agg(F.min(key).alias("id_")).withColumn("n_", F.length("text_"))
    padded = F.concat(F.lit("\x01"), F.col("text_"), F.lit("\x02"))
    grams = F.transform(F.sequence(F.lit(1), F.col("n_") + 1), lambda i: F.substr(padded, i, F.lit(2)))
    g = t.select("block", "id_", "n_", F.explode(grams).alias("g_")).groupBy("block", "id_", "n_", "g_").agg(F.count(F.lit(1)).alias("c_"))
    g = g.withColumn("i_", F.explode(F.sequence(F.lit(1), F.col("c_").cast("int")))).drop("c_")
    common = g.groupBy("block", "g_", "i_").agg(F.count(F.lit(1)).alias("f_"))
    ranked = g.join(common, ["block", "g_", "i_"]).groupBy("block", "id_", "n_").agg(F.array_sort(F.collect_list(F.struct("f_", "g_", "i_"))).alias("all_"))
    longest = F.floor(F.col("n_") * 100 / percent)
    edits = F.floor(longest * (100 - percent) / 100)
    prefix = ranked.select("block", "id_", "n_", F.explode(F.slice("all_", F.lit(1), (2 * edits + 1).cast("int"))).alias("p_")).select("block", "id_", "n_", "p_.g_", "p_.i_")
    other = prefix.select("block", "g_", "i_", F.col("id_").alias("b"), F.col("n_").alias("m_"))
    near = (F.least("n_", "m_") * 100 >= F.greatest("n_", "m_") * percent) & (F.col("id_") < F.col("b"))
    pairs = prefix.join(other, ["block", "g_", "i_"]).where(near).select("block", F.col("id_").alias("a"), "b").distinct()
    if dismissed is not None:
        d = dismissed.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        pairs = pairs.join(d.distinct(), ["a", "b"], "left_anti")
    side = lambda k, x: t.select("block", F.col("id_").alias(k), F.col("text_").alias(x))
    met = pairs.join(side("a", "x_"), ["block", "a"]).join(side("b", "y_"), ["block", "b"])
    d, most = F.levenshtein("x_", "y_"), F.greatest(F.length("x_"), F.length("y_"))
    return met.where(d * 100 <= most * (100 - percent)).select("a", "b", "block", F.round(1 - d / most, 4).alias("similarity"))


def review_groups(items: DataFrame, by: Sequence[str], key: str, order: Sequence[Column]) -> DataFrame:
    """Groups of two or more: by, n, the member that stands for it (the first in the order) and the smallest and largest key."""
    g = items.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min_by(key, F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])).alias("primary"), F.min(key).alias("least"), F.max(key).alias("most"))
    return g.where("n > 1")


def misfiled(facts: DataFrame, parents: DataFrame, item: str, parent: str, raw: str, owner: str, title: str, there: int = 60, here: int = 34) -> DataFrame:
    """(parent, target, n, share, strong): facts filed under a parent whose raw text names another one of the same owner, by the only parent of that name. strong: `there` percent or more of the target's items are among them, and they are `here` percent or less of the parent's items."""
    p = parents.select(parent, owner, fold(F.col(title)).alias("k_"))
    only = p.groupBy(owner, "k_").agg(F.min(parent).alias("target"), F.max(parent).alias("hi_")).where("target = hi_").drop("hi_")
    f = facts.select(item, parent, fold(F.col(raw)).alias("k_"))
    wrong = f.join(p.select(parent, owner), parent).join(only, [owner, "k_"]).where(F.col("target") != F.col(parent))
    pairs = wrong.groupBy(parent, "target").agg(F.count(F.lit(1)).alias("n"), F.countDistinct(item).alias("m_"))
    size = facts.groupBy(parent).agg(F.countDistinct(item).alias("s_"))
    met = pairs.join(size.withColumnRenamed("s_", "here_"), parent).join(size.select(F.col(parent).alias("target"), F.col("s_").alias("there_")), "target", "left")
    strong = (F.col("m_") * 100 >= F.col("there_") * there) & (F.col("m_") * 100 <= F.col("here_") * here)
    return met.select(parent, "target", "n", F.col("m_").alias("items"), F.coalesce(strong, F.lit(False)).alias("strong"))


def misplaced(items: DataFrame, credits: DataFrame, item: str, parent: str, owner: str) -> DataFrame:
    """Items whose parent doesn't credit their owner, with the most frequent parent that does (ties by the smaller one), else null. items (item, parent, owner, n), one row for each parent an item was met on; the one with most rows is its own."""
    first = items.groupBy(item, owner).agg(F.max_by(parent, F.struct("n", -F.col(parent))).alias(parent))
    wrong = first.join(credits.select(parent, owner).distinct(), [parent, owner], "left_anti")
    right = items.join(credits.select(parent, owner).distinct(), [parent, owner], "left_semi").groupBy(item, owner).agg(F.max_by(parent, F.struct("n", -F.col(parent))).alias("better"))
    return wrong.join(right, [item, owner], "left").select(item, parent, "better")


def match_lists(lines: DataFrame, items: DataFrame, parent: str, line: str, item: str, title: str, rules: Mapping[str, Column]) -> DataFrame:
    """(parent, line, item, rule): each line of a list with at most one item of the same parent, each item used once. Rules are keys that line and item must share, tried one after the other; the nth line of a key takes its nth item, so equal titles pair up in order."""
    left, right, out = lines.select(parent, line, title), items.select(parent, item, title), None
    for name, k in rules.items():
        nth = lambda df, x, k=k: df.withColumn("k_", k).where(F.col("k_").isNotNull() & (F.col("k_") != "")).withColumn("nth_", F.row_number().over(Window.partitionBy(parent, "k_").orderBy(x))).drop(title)
        hit = nth(left, line).join(nth(right, item), [parent, "k_", "nth_"]).select(parent, line, item, F.lit(name).alias("rule"))
        out = hit if out is None else out.unionByName(hit)
        left, right = left.join(hit, [parent, line], "left_anti"), right.join(hit, [parent, item], "left_anti")
    return out


# --- review ----------------------------------------------------------------------------------

def missing_queue(df: DataFrame, attr: str, key: str, weights: Mapping[str, int], excluded: DataFrame) -> DataFrame:
    """(key, weight): rows without an attribute, heaviest first, without those marked as right as they are."""
    weight = sum((F.coalesce(F.col(c), F.lit(0)) * w for c, w in weights.items()), F.lit(0))
    return df.where(F.col(attr).isNull()).join(excluded.select(key).distinct(), key, "left_anti").select(key, weight.cast("long").alias("weight")).orderBy(F.desc("weight"), key)


def review_status(now: DataFrame, marks: DataFrame, key: str, sign: str, gaps: str) -> DataFrame:
    """Add status: needs work (gaps left), unreviewed, changed (the signature is not the reviewed one) or reviewed. marks (key, sign)."""
    met = now.join(marks.select(key, F.col(sign).alias("was_"), F.lit(True).alias("in_")), key, "left")
    status = F.when(F.col(gaps) > 0, "needs work").when(F.col("in_").isNull(), "unreviewed").when(~F.col("was_").eqNullSafe(F.col(sign)), "changed").otherwise("reviewed")
    return met.select(*now.columns, status.alias("status"))


def inbox(findings: DataFrame, run: str, kind: str, subject: str) -> DataFrame:
    """(run, questions, subjects, kinds): the distinct open questions of each run."""
    return findings.where(~F.col("settled")).groupBy(run).agg(F.countDistinct(kind, subject).alias("questions"), F.countDistinct(subject).alias("subjects"), F.countDistinct(kind).alias("kinds"))


# --- edits -----------------------------------------------------------------------------------

def fill_from_cache(df: DataFrame, cache: DataFrame, key: str, attr: str, manual: str) -> DataFrame:
    """Add status and filled: manual (set by hand, stays), pending (not looked up yet), notfound (looked up, nothing there), set, change or same. cache (key, value)."""
    met = df.join(cache.select(key, F.col("value").alias("v_"), F.lit(True).alias("in_")), key, "left")
    status = F.when(F.col(manual), "manual").when(F.col("in_").isNull(), "pending").when(F.col("v_").isNull(), "notfound").when(F.col(attr).isNull(), "set").when(F.col(attr) == F.col("v_"), "same").otherwise("change")
    takes = F.col("status").isin("set", "change")
    return met.withColumn("status", status).select(*df.columns, "status", F.when(takes, F.col("v_")).otherwise(F.col(attr)).alias("filled"))


def split_out(facts: DataFrame, parent: str, raw: str, splits: DataFrame) -> DataFrame:
    """Facts with splits (parent, raw, target) made: rows of a parent with that raw text, case aside, go to the target; moved: true for them. Of several targets of one text the smallest counts."""
    to = splits.groupBy(F.col("parent").alias("p_"), F.lower("raw").alias("r_")).agg(F.min("target").alias("t_"))
    met = facts.join(to, (F.col(parent) == F.col("p_")) & (F.lower(raw) == F.col("r_")), "left")
    return met.select(*[F.coalesce("t_", c).alias(c) if c == parent else F.col(c) for c in facts.columns], F.col("t_").isNotNull().alias("moved"))


def relink_lines(lines: DataFrame, events: DataFrame, event: str, actor: str, item: str, mapping: DataFrame) -> DataFrame:
    """Lines with their item replaced where the event's actor and the item are in mapping (actor, item, target)."""
    met = lines.join(events.select(event, actor), event, "left").join(mapping.select(actor, item, F.col("target").alias("t_")), [actor, item], "left")
    return met.select(*[F.coalesce("t_", item).alias(c) if c == item else F.col(c) for c in lines.columns], F.col("t_").isNotNull().alias("moved"))


def fill_lengths(lines: DataFrame, items: DataFrame, parent: str, key: str, length: str) -> DataFrame:
    """(parent, lines, known, total): lengths of lines, else of the parent's items of the same key; the total only where every length is known."""
    have = items.where(F.col(length).isNotNull()).groupBy(parent, key).agg(F.min(length).alias("l_"))
    n = F.coalesce(F.col(length), F.col("l_"))
    g = lines.join(have, [parent, key], "left").groupBy(parent).agg(F.count(F.lit(1)).alias("lines"), F.count(n).alias("known"), F.sum(n).alias("s_"))
    return g.select(parent, "lines", "known", F.when(F.col("lines") == F.col("known"), F.col("s_")).alias("total"))


# --- tags ------------------------------------------------------------------------------------

def similar_by_tags(tags: DataFrame, entity: str, tag: str, owner: str, of: DataFrame, k: int, used: DataFrame | None = None) -> DataFrame:
    """(entity, other, score, nth): for each entity of `of`, the k of other owners that share most tag weight, rare tags weighing more; only those in used (entity), if given. Ties by the smaller one."""
    t = tags.select(entity, tag, owner).distinct()
    n = t.select(entity).distinct().agg(F.count(F.lit(1)).alias("n_"))
    weight = t.groupBy(tag).agg(F.count(F.lit(1)).alias("f_")).crossJoin(F.broadcast(n)).select(tag, F.log(1 + F.col("n_") / F.col("f_")).alias("w_"))
    mine = t.join(of.select(entity).distinct(), entity, "left_semi").join(weight, tag)
    other = t.select(F.col(entity).alias("other"), tag, F.col(owner).alias("owner_"))
    if used is not None:
        other = other.join(used.select(F.col(entity).alias("other")).distinct(), "other", "left_semi")
    g = mine.join(other, tag).where(~F.col(owner).eqNullSafe(F.col("owner_"))).groupBy(entity, "other").agg(F.round(F.sum("w_"), 6).alias("score"))
    return g.withColumn("nth", F.row_number().over(Window.partitionBy(entity).orderBy(F.desc("score"), "other"))).where(F.col("nth") <= k)


def tag_index(tags: DataFrame, entity: str, tag: str, source: str, owned: DataFrame) -> DataFrame:
    """(tag, entities, sources, owned): entities and sources of each tag, and how many of its entities are owned."""
    o = owned.select(entity).distinct().withColumn("o_", F.lit(1))
    return tags.join(o, entity, "left").groupBy(tag).agg(F.countDistinct(entity).alias("entities"), F.countDistinct(source).alias("sources"), F.countDistinct(F.when(F.col("o_") == 1, F.col(entity))).alias("owned"))


def suggest_tags(sources: Mapping[str, DataFrame], have: DataFrame, hidden: DataFrame, entity: str, tag: str) -> DataFrame:
    """(entity, tag, reasons): tags that any source gives an entity and that it neither has nor hides, with the names of those sources, sorted."""
    out = None
    for name, df in sources.items():
        said = df.select(entity, tag).distinct().withColumn("why_", F.lit(name))
        out = said if out is None else out.unionByName(said)
    for gone in (have, hidden):
        out = out.join(gone.select(entity, tag).distinct(), [entity, tag], "left_anti")
    return out.groupBy(entity, tag).agg(F.array_join(F.array_sort(F.collect_set("why_")), ", ").alias("reasons"))


# --- compositions ----------------------------------------------------------------------------

def fold_places(places: DataFrame, place: str, city: str, stage: str, n: str) -> DataFrame:
    """(place, folded): a stage counts as the busiest place of its city that is none, ties by the smaller one; where there is none it stays itself."""
    hall = places.where(~F.col(stage)).groupBy(city).agg(F.min_by(place, F.struct((-F.coalesce(F.col(n), F.lit(0))).alias("n"), place)).alias("hall_"))
    return places.join(hall, city, "left").select(place, F.when(F.col(stage), F.coalesce("hall_", place)).otherwise(F.col(place)).alias("folded"))


def compare_pairs(facts: DataFrame, actor: str, item: str, pairs: DataFrame) -> DataFrame:
    """(a, b, shared, of_a, of_b) for given pairs (a, b): distinct items of each and of both. Only items of the pairs' actors are joined."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias(actor)).distinct()
    s = facts.join(wanted, actor, "left_semi").select(actor, item).distinct()
    n = s.groupBy(actor).agg(F.count(F.lit(1)).alias("n_"))
    side = lambda k: s.select(F.col(actor).alias(k), item)
    shared = pairs.join(side("a"), "a").join(side("b"), ["b", item]).groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))
    size = lambda k: n.select(F.col(actor).alias(k), F.col("n_").alias(f"of_{k}"))
    return shared.join(size("a"), "a").join(size("b"), "b").select("a", "b", "shared", "of_a", "of_b")
