"""Resolving sightings of works, items and places by rules in order, and what follows from how they were resolved."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annalist.functions.inventory import tag_name
from annalist.functions.text import fold
from annalist.functions.titles import no_item_kind, split_title
from annalist.operators.entities import numbered


def resolve_by(df: DataFrame, rules: Sequence[tuple[str, DataFrame, Column]], new_key: Column, dim: DataFrame) -> DataFrame:
    """Add entity and how: the first rule (name, lookup (k, entity), key) whose lookup has the row's key; else new, numbered after dim's largest entity, one number for each new key; a null new key leaves the row without an entity.

    Of several entities under one key the smallest counts, so a rule joins one row at most.
    """
    columns, names = df.columns, []
    for i, (name, lookup, key) in enumerate(rules):
        one = lookup.where(F.col("k").isNotNull()).groupBy(F.col("k").alias(f"k{i}_")).agg(F.min("entity").alias(f"e{i}_"))
        df = df.withColumn(f"by{i}_", key).join(one, F.col(f"by{i}_") == F.col(f"k{i}_"), "left")
        names.append(F.when(F.col(f"e{i}_").isNotNull(), F.lit(name)))
    known = F.coalesce(*[F.col(f"e{i}_") for i in range(len(rules))])
    df = df.withColumns({"known_": known, "new_k_": new_key}).withColumn("how", F.coalesce(*names, F.when(F.col("new_k_").isNotNull(), "new")))
    top = dim.agg(F.coalesce(F.max("entity"), F.lit(0)).alias("top_"))  # one row
    new = numbered(df.where("how = 'new'"), "new_k_", "nth_").crossJoin(F.broadcast(top)).select("new_k_", (F.col("top_") + F.col("nth_")).alias("new_"))
    return df.join(new, "new_k_", "left").select(*columns, F.coalesce("known_", F.when(F.col("how") == "new", F.col("new_"))).alias("entity"), "how")


def title_key(actor: str, title: str) -> Column:
    """An actor and the folded title without its suffixes, as one key; null without either."""
    return F.concat(F.col(actor).cast("string"), F.lit(":"), F.nullif(fold(split_title(F.col(title))["base"]), F.lit("")))


def resolve_child(df: DataFrame, dim: DataFrame, aliases: DataFrame, editions: DataFrame, groups: DataFrame) -> DataFrame:
    """Works (actor, title, edition, grp): an alias of the actor's title, the edition's id, the group the edition belongs to, the group's own id, the actor's title, else new.

    dim (entity, actor, title, grp), aliases (actor, alias, entity), editions (edition, entity), groups (edition, grp).
    """
    spelled = lambda t: F.concat(F.col("actor").cast("string"), F.lit(":"), F.lower(F.trim(t)))
    own = dim.select(F.col("grp").alias("k"), "entity")
    rules = [
        ("alias", aliases.select(spelled("alias").alias("k"), "entity"), spelled("title")),
        ("edition", editions.select(F.col("edition").alias("k"), "entity"), F.col("edition")),
        ("via group", groups.join(dim.where("grp is not null").select("grp", "entity"), "grp").select(F.col("edition").alias("k"), "entity"), F.col("edition")),
        ("group", own, F.col("grp")),
        ("title", dim.select(title_key("actor", "title").alias("k"), "entity"), title_key("actor", "title")),
    ]
    return resolve_by(df, rules, title_key("actor", "title"), dim)


def resolve_item(df: DataFrame, dim: DataFrame, aliases: DataFrame) -> DataFrame:
    """Items (actor, title, item_id, slot_id): an alias, the item's own id, its slot on an edition, the actor's title, else new. dim (entity, actor, title, item_id), slots in aliases as (kind alias or slot, k, entity)."""
    spelled = F.concat(F.col("actor").cast("string"), F.lit(":"), F.lower(F.trim("title")))
    kind = lambda x: aliases.where(F.col("kind") == x).select("k", "entity")
    rules = [
        ("alias", kind("alias"), spelled),
        ("id", dim.select(F.col("item_id").alias("k"), "entity"), F.col("item_id")),
        ("slot", kind("slot"), F.col("slot_id")),
        ("title", dim.select(title_key("actor", "title").alias("k"), "entity"), title_key("actor", "title")),
    ]
    return resolve_by(df, rules, title_key("actor", "title"), dim)


def first_parent(facts: DataFrame, item: str, parent: str, ts: str) -> DataFrame:
    """(item, parent): the parent an item was first seen with; of one time the smallest."""
    return facts.where(F.col(parent).isNotNull()).groupBy(item).agg(F.min_by(parent, F.struct(ts, parent)).alias(parent))


def resolve_places(df: DataFrame, dim: DataFrame) -> DataFrame:
    """Places (ext, name, city): by id, else by name and city, else new; rows of one name and city are one new place. dim (entity, ext, name, city)."""
    both = F.concat_ws("|", F.lower(F.trim("name")), F.lower(F.trim(F.coalesce("city", F.lit("")))))
    named = F.when(F.col("name").isNotNull(), both)
    return resolve_by(df, [("id", dim.select(F.col("ext").alias("k"), "entity"), F.col("ext")), ("name", dim.select(both.alias("k"), "entity"), named)], named, dim)


def relink_covers(lines: DataFrame, aliases: DataFrame) -> DataFrame:
    """Lines (performer, title, item) with the item an alias of this performer's title names, else the one they have; relinked says which. aliases (performer, title, item); of several the smallest."""
    a = aliases.groupBy(F.col("performer").alias("p_"), F.lower("title").alias("t_")).agg(F.min("item").alias("to_"))
    met = lines.join(a, (F.col("performer") == F.col("p_")) & (F.lower("title") == F.col("t_")), "left")
    return met.select(*[F.coalesce("to_", "item").alias("item") if c == "item" else F.col(c) for c in lines.columns], F.coalesce(F.col("to_") != F.col("item"), F.col("to_").isNotNull()).alias("relinked"))


def credit_guard(resolved: DataFrame, credits: DataFrame, id_sets: DataFrame, various: Sequence[str]) -> DataFrame:
    """Add mismatch: the group is credited, but to none of the actor's ids and not to various. resolved (actor, grp, ...), credits (grp, ext), id_sets (actor, ids)."""
    c = credits.groupBy("grp").agg(F.collect_set("ext").alias("credited_"))
    met = resolved.join(c, "grp", "left").join(id_sets.select("actor", "ids"), "actor", "left")
    named = F.concat(F.coalesce("ids", F.array().cast("array<string>")), F.array(*[F.lit(x) for x in various]))
    return met.select(*resolved.columns, F.coalesce(F.size("credited_") > 0, F.lit(False)).alias("has_"), (~F.arrays_overlap(F.coalesce("credited_", F.array().cast("array<string>")), named)).alias("miss_")).withColumn("mismatch", F.col("has_") & F.col("miss_")).drop("has_", "miss_")


def edition_report(parents: DataFrame, cache: DataFrame) -> DataFrame:
    """(entity, status, grp) of parents (entity, ext) known by an edition: convert, duplicate (others convert to the group or hold it), invalid (looked up, nothing there) or lookup. cache (ext, grp: null for nothing); parents whose id is a group already are done."""
    looked = cache.groupBy("ext").agg(F.max("grp").alias("grp"), F.lit(True).alias("in_"))
    groups = cache.where(F.col("grp").isNotNull()).select(F.col("grp").alias("ext")).distinct().withColumn("is_", F.lit(True))
    met = parents.select("entity", "ext").join(looked, "ext", "left").join(groups, "ext", "left")
    target = F.when(F.col("is_"), F.col("ext")).otherwise(F.col("grp"))
    met = met.select("entity", target.alias("grp"), "in_", "is_")
    same = met.where(F.col("grp").isNotNull()).groupBy("grp").agg(F.count(F.lit(1)).alias("n_"))
    status = F.when(F.col("is_"), "done").when(F.col("in_").isNull(), "lookup").when(F.col("grp").isNull(), "invalid").when(F.col("n_") > 1, "duplicate").otherwise("convert")
    return met.join(same, "grp", "left").select("entity", status.alias("status"), "grp")


def split_rows(items: DataFrame, facts: DataFrame, lines: DataFrame, item: str, key: str) -> DataFrame:
    """(key, played, seen): keys of items some of whose rows only have facts while others only have event lines, with the smallest of each."""
    has = lambda df, n: df.select(item).distinct().withColumn(n, F.lit(True))
    met = items.select(item, key).join(has(facts, "f_"), item, "left").join(has(lines, "l_"), item, "left")
    only = lambda a, b: F.when(F.col(a).isNotNull() & F.col(b).isNull(), F.col(item))
    return met.groupBy(key).agg(F.min(only("f_", "l_")).alias("played"), F.min(only("l_", "f_")).alias("seen")).where("played is not null and seen is not null")


def group_items(items: DataFrame, facts: DataFrame, lines: DataFrame, item: str, parent: str, key: str) -> DataFrame:
    """(parent, key, n, plays, shows, item): rows of one key on a parent as one, with the facts and distinct events of all and the row that stands for them: the most played, then the smallest."""
    plays = facts.groupBy(item).agg(F.count(F.lit(1)).alias("p_"))
    met = items.select(item, parent, key).join(plays, item, "left").withColumn("p_", F.coalesce("p_", F.lit(0)))
    main = met.groupBy(parent, key).agg(F.count(F.lit(1)).alias("n"), F.sum("p_").alias("plays"), F.min_by(item, F.struct(-F.col("p_"), item)).alias(item))
    shows = lines.select(item, "event").join(items.select(item, parent, key), item).groupBy(parent, key).agg(F.countDistinct("event").alias("shows"))
    return main.join(shows, [parent, key], "left").select(parent, key, "n", "plays", F.coalesce("shows", F.lit(0)).alias("shows"), item)


def tags_to_parents(groups: DataFrame, parents: DataFrame, resolved: DataFrame) -> DataFrame:
    """(parent, tag) of tags by group (grp, tag), for parents (parent, ext) known by the group itself or by an id that resolves to it (ext, grp)."""
    r = resolved.groupBy("ext").agg(F.min("grp").alias("r_"))
    direct = groups.select(F.col("grp").alias("ext")).distinct().withColumn("d_", F.lit(True))
    target = parents.join(direct, "ext", "left").join(r, "ext", "left").select("parent", F.when(F.col("d_"), F.col("ext")).otherwise(F.col("r_")).alias("grp"))
    return target.join(groups, "grp").select("parent", "tag").distinct()


def style_tags(copies: DataFrame, parent: str, styles: str) -> DataFrame:
    """(parent, tag): the styles, a JSON list in text, of all copies of a parent, under the names that tags are stored by."""
    each = copies.select(parent, F.explode(F.from_json(styles, "array<string>")).alias("s_"))
    return each.select(parent, tag_name(F.col("s_")).alias("tag")).where("tag <> ''").distinct()


def tag_fill_plan(parents: DataFrame, own: DataFrame, editions: DataFrame, pending: DataFrame, least: int = 2) -> DataFrame:
    """(parent, status, tags): where a parent's tags would come from. group: its own votes (parent, tag, n) give some of `least` or more; editions: those of its editions do, summed; edition: a single one names any; pending: still to look up (parent); none."""
    good = lambda df: df.groupBy("parent", "tag").agg(F.sum("n").alias("n"))
    enough = lambda df, name: good(df).where(F.col("n") >= least).groupBy("parent").agg(F.array_sort(F.collect_list("tag")).alias(name))
    any_ = editions.groupBy("parent").agg(F.array_sort(F.collect_set("tag")).alias("c_"))
    met = parents.select("parent").join(enough(own, "a_"), "parent", "left").join(enough(editions, "b_"), "parent", "left").join(any_, "parent", "left").join(pending.select("parent").distinct().withColumn("p_", F.lit(True)), "parent", "left")
    status = F.when(F.col("a_").isNotNull(), "group").when(F.col("b_").isNotNull(), "editions").when(F.col("c_").isNotNull(), "edition").when(F.col("p_"), "pending").otherwise("none")
    return met.select("parent", status.alias("status"), F.coalesce("a_", "b_", "c_", F.array().cast("array<string>")).alias("tags"))


def compare_catalogue(local: DataFrame, external: DataFrame) -> DataFrame:
    """(ext, entity, how) of an external catalogue (actor, title, ext) against the local one (actor, title, entity, ext): linked by id, else matched by the actor's title, else missing."""
    by_id = local.where(F.col("ext").isNotNull()).groupBy("ext").agg(F.min("entity").alias("i_"))
    by_title = local.groupBy(title_key("actor", "title").alias("k_")).agg(F.min("entity").alias("t_"))
    met = external.join(by_id, "ext", "left").withColumn("key_", title_key("actor", "title")).join(by_title, F.col("key_") == F.col("k_"), "left")
    return met.select("ext", F.coalesce("i_", "t_").alias("entity"), F.when(F.col("i_").isNotNull(), "linked").when(F.col("t_").isNotNull(), "title").otherwise("missing").alias("how"))


def line_progress(status: DataFrame, event: str, done: Sequence[str], todo: Sequence[str]) -> DataFrame:
    """(event, lines, done, todo, unchecked): how far an event's lines (event, status) are settled."""
    n = lambda values, name: F.count_if(F.col("status").isin(*values)).alias(name)
    out = status.groupBy(event).agg(F.count(F.lit(1)).alias("lines"), n(done, "done"), n(todo, "todo"))
    return out.withColumn("unchecked", F.col("lines") - F.col("done") - F.col("todo"))


def apply_decisions(findings: DataFrame, decisions: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Findings with their decision (accept, merge, mine, theirs, reject; open without one) and the changes that follow: (key, action, target). Of several decisions on one finding the latest counts."""
    last = decisions.groupBy(key).agg(F.max_by(F.struct("decision", "target"), F.struct("at", "decision", "target")).alias("d_"))
    met = findings.join(last, key, "left").withColumns({"decision": F.coalesce("d_.decision", F.lit("open")), "target": F.col("d_.target")}).drop("d_")
    action = F.when(F.col("decision").isin("accept", "theirs"), "take").when(F.col("decision") == "merge", "merge").when(F.col("decision") == "reject", "mark")
    return met, met.select(key, action.alias("action"), "target").where("action is not null")


def variant_merges(journal: DataFrame, items: DataFrame) -> DataFrame:
    """(absorbed, canonical, tags): past merges (absorbed_title, canonical) of a title whose tags name another recording than the title it went to. items (item, title)."""
    apart = ["live", "demo", "remix", "acoustic", "instrumental", "rerecording"]
    tags = lambda c: F.array_intersect(split_title(F.col(c))["tags"], F.array(*[F.lit(x) for x in apart]))
    met = journal.join(items.select(F.col("item").alias("canonical"), F.col("title").alias("now_")), "canonical")
    out = met.select("absorbed", "canonical", F.array_except(tags("absorbed_title"), tags("now_")).alias("tags"))
    return out.where(F.size("tags") > 0)


def review_tags(current: DataFrame, decisions: DataFrame, hidden: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tags (entity, tag) after decisions (entity, tag, decision), the hidden ones, and the journal (entity, tag, action). keep: stays, or comes in; drop: goes; reject: goes and is hidden, so that no source brings it back. Of several decisions on one tag the last in this order counts."""
    d = decisions.groupBy("entity", "tag").agg(F.max(F.struct(F.array_position(F.array(*[F.lit(x) for x in ("keep", "drop", "reject")]), F.col("decision")).alias("o"), "decision")).alias("d_")).select("entity", "tag", F.col("d_.decision").alias("decision"))
    gone = d.where("decision <> 'keep'").select("entity", "tag")
    after = current.select("entity", "tag").unionByName(d.where("decision = 'keep'").select("entity", "tag")).distinct().join(gone, ["entity", "tag"], "left_anti")
    hid = hidden.select("entity", "tag").unionByName(d.where("decision = 'reject'").select("entity", "tag")).distinct()
    was = current.select("entity", "tag").distinct().withColumn("was_", F.lit(True))
    journal = after.withColumn("is_", F.lit(True)).join(was, ["entity", "tag"], "full").where("was_ is null or is_ is null")
    return after, hid, journal.select("entity", "tag", F.when(F.col("is_"), "added").otherwise("removed").alias("action"))


def version_groups(parents: DataFrame, key: str, owner: str, title: str, order: Sequence[Column]) -> DataFrame:
    """(owner, k, n, primary, members): parents of one owner whose titles agree but for their suffixes, two or more; the one that stands for them has no suffix if any has none, then comes first in the order."""
    t = parents.withColumn("s_", split_title(F.col(title))).withColumn("k", fold(F.col("s_.base")))
    first = F.struct((F.size("s_.tags") > 0).alias("o0"), *[o.alias(f"o{i}") for i, o in enumerate(order, 1)])
    return t.where("k <> ''").groupBy(owner, "k").agg(F.count(F.lit(1)).alias("n"), F.min_by(key, first).alias("primary"), F.array_sort(F.collect_list(key)).alias("members")).where("n > 1")


def list_queue(matches: DataFrame, lines: DataFrame, items: DataFrame, parent: str) -> DataFrame:
    """(parent, lines, matched, empty, extra): how many lines of a parent's list are matched by an item, how many have none, and how many items stand on no line. matches (parent, line, item)."""
    n = lambda df, name: df.groupBy(parent).agg(F.count(F.lit(1)).alias(name))
    met = n(lines, "lines").join(matches.groupBy(parent).agg(F.countDistinct("line").alias("matched"), F.countDistinct("item").alias("used_")), parent, "full").join(n(items, "items_"), parent, "full")
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    return met.select(parent, z("lines").alias("lines"), z("matched").alias("matched"), (z("lines") - z("matched")).alias("empty"), F.greatest(z("items_") - z("used_"), F.lit(0)).alias("extra"))


def evidence_for(bronze: DataFrame, ids: DataFrame, path: str, keep: Sequence[str]) -> DataFrame:
    """Untouched source rows (json, ...) that carry one of the ids (id) at a JSON path: the id and the columns to keep."""
    found = bronze.select(F.get_json_object("json", path).alias("id"), *keep)
    return found.join(ids.select("id").distinct(), "id", "left_semi")


def groups_of_item(listed: DataFrame, items: DataFrame) -> DataFrame:
    """(item, grp, date, nth): groups whose lists (grp, title, kind, date) hold an item's folded title, each by its earliest date; studio groups first, then by date, then by name."""
    one = listed.withColumn("k_", fold(F.col("title"))).groupBy("k_", "grp").agg(F.min("date").alias("date"), F.min((F.col("kind") != "studio").cast("int")).alias("o_"))
    met = items.select("item", fold(F.col("title")).alias("k_")).where("k_ <> ''").join(one, "k_")
    return met.select("item", "grp", "date", F.row_number().over(Window.partitionBy("item").orderBy("o_", F.col("date").asc_nulls_last(), "grp")).alias("nth"))


def item_id_report(items: DataFrame, known: DataFrame) -> DataFrame:
    """(item, status, target) of items (item, ext) by what a look-up says of their id (ext, kind, target): confirmed (an item's own id), convert (a slot's, to its target), duplicate (several items would get one target), invalid (nothing known) or pending (not looked up)."""
    k = known.groupBy("ext").agg(F.max(F.struct("kind", "target")).alias("k_"), F.lit(True).alias("in_"))
    met = items.select("item", "ext").join(k, "ext", "left").withColumn("target", F.when(F.col("k_.kind") == "item", F.col("ext")).otherwise(F.col("k_.target")))
    same = met.where("target is not null").groupBy("target").agg(F.count(F.lit(1)).alias("n_"))
    met = met.join(same, "target", "left")
    status = F.when(F.col("in_").isNull(), "pending").when(F.col("target").isNull(), "invalid").when(F.col("n_") > 1, "duplicate").when(F.col("k_.kind") == "item", "confirmed").otherwise("convert")
    return met.select("item", status.alias("status"), "target")


def suggest_links(copies: DataFrame, editions: DataFrame) -> DataFrame:
    """(copy, edition, relation) of copies (copy, code, year) and editions (edition, code, year, part_of) with one code: same (the years agree or one is unknown), set (the edition is a part of a set) or differs."""
    met = copies.where("code is not null").alias("c").join(editions.alias("e"), F.col("c.code") == F.col("e.code"))
    relation = F.when(F.col("e.part_of").isNotNull(), "set").when(F.coalesce(F.col("c.year") == F.col("e.year"), F.lit(True)), "same").otherwise("differs")
    return met.select("copy", "edition", relation.alias("relation"))


def verify_flags(entities: DataFrame, flags: dict[str, Column], key: str) -> DataFrame:
    """(key, flags): the names of the checks an entity fails, in the order given; entities that fail none are left out."""
    failed = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in flags.items()]))
    return entities.select(key, failed.alias("flags")).where(F.size("flags") > 0)


def checklist(copies: DataFrame, checks: dict[str, tuple[Column, Column]], key: str) -> DataFrame:
    """(key, items array<struct<check, status>>, score): the state of each check (applies, passes) of a copy: ok, bad or none, and the percent of those that apply which are ok."""
    state = lambda applies, passes: F.when(~F.coalesce(applies, F.lit(False)), "none").when(F.coalesce(passes, F.lit(False)), "ok").otherwise("bad")
    items = F.array(*[F.struct(F.lit(name).alias("check"), state(*c).alias("status")) for name, c in checks.items()])
    n = lambda s: F.size(F.filter("items", lambda x: x["status"] == s))
    return copies.select(key, items.alias("items")).withColumn("score", F.round(100 * n("ok") / F.nullif(n("ok") + n("bad"), F.lit(0)), 1))


def line_status(lines: DataFrame, placed: DataFrame, titled: DataFrame, listed: DataFrame, looked: DataFrame) -> DataFrame:
    """Add status and match to event lines (line, actor, title, item). ok: the item stands on a parent (placed: item); match: another item of the actor's title does (titled: actor, title, item, the smallest); listed: the title is on a list of the actor (listed: actor, title); a kind of line that is no item; looked up: a look-up knows the title (looked: actor, title); unchecked."""
    key = title_key("actor", "title")
    there = lambda df, n: df.select(key.alias(f"{n}k_")).distinct().withColumn(n, F.lit(True))
    ok = placed.select(F.col("item").alias("pi_")).distinct().withColumn("placed_", F.lit(True))
    other = titled.join(placed.select("item").distinct(), "item", "left_semi").groupBy(key.alias("tk_")).agg(F.min("item").alias("match"))
    met = lines.withColumn("key_", key).join(ok, F.col("item") == F.col("pi_"), "left").join(other, F.col("key_") == F.col("tk_"), "left")
    met = met.join(there(listed, "l_"), F.col("key_") == F.col("l_k_"), "left").join(there(looked, "c_"), F.col("key_") == F.col("c_k_"), "left")
    status = F.when(F.col("placed_"), "ok").when(F.col("match").isNotNull(), "match").when(F.col("l_"), "listed").otherwise(F.coalesce(no_item_kind(F.col("title")), F.when(F.col("c_"), "looked up"), F.lit("unchecked")))
    return met.select(*lines.columns, status.alias("status"), F.when(status == "match", F.col("match")).alias("match"))
