"""Canonical entities and their history: merges and their reversal, reconciling, refreshing, tags, checks. Bulk jobs over whole tables."""

from __future__ import annotations

import tempfile
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annalist.operators.similar import look_alikes


def cut(df: DataFrame) -> DataFrame:
    """df without its lineage, checkpointed in the session's shared folder; in a temporary one only in a local session that names none."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return df.checkpoint()


# --- refreshing and comparing ----------------------------------------------------------------

def since_watermark(new: DataFrame, have: DataFrame, ts: str) -> DataFrame:
    """Rows later than the latest one already there; all rows if there is none."""
    mark = have.agg(F.max(ts).alias("mark_"))
    return new.join(F.broadcast(mark), F.col("mark_").isNull() | (F.col(ts) > F.col("mark_"))).drop("mark_")


def replace_by_key(target: DataFrame, updates: DataFrame, keys: Sequence[str], deleted: DataFrame | None = None) -> DataFrame:
    """The target with all rows of the keys in updates (and in deleted) replaced by the rows of updates."""
    gone = updates.select(*keys) if deleted is None else updates.select(*keys).union(deleted.select(*keys))
    return target.join(gone.distinct(), list(keys), "left_anti").unionByName(updates)


def lookup_todo(df: DataFrame, cached: DataFrame, key: str, weight: str, budget: int) -> DataFrame:
    """The first `budget` keys that are not cached yet, heaviest first."""
    return df.join(cached.select(key).distinct(), key, "left_anti").select(key, weight).orderBy(F.desc(weight), key).limit(budget)


def profile(df: DataFrame) -> DataFrame:
    """(column, type, n, nulls) of every column, in one scan."""
    row = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(c).alias(f"c{i}") for i, c in enumerate(df.columns)])
    each = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(kind).alias("type"), F.col("n").alias("n"), (F.col("n") - F.col(f"c{i}")).alias("nulls")) for i, (c, kind) in enumerate(df.dtypes)])
    return row.select(F.inline(each))


def change_report(before: DataFrame, after: DataFrame, key: str, entity: str) -> DataFrame:
    """(entity, had, added): rows that each entity had, and rows of it whose key is new."""
    had = before.select(key).distinct().withColumn("old_", F.lit(True))
    return after.join(had, key, "left").groupBy(entity).agg(F.count("old_").alias("had"), F.count_if(F.col("old_").isNull()).alias("added"))


def refresh_report(before: DataFrame, after: DataFrame, key: str, entity: str, name: str, top: int = 8, ratio: float = 87) -> DataFrame:
    """(kind, label, n, other): what a refresh brought. total: rows before, under "was", and after, under "now"; added: the `top` entities by new rows (a row is new by its key), ties by entity; look_alike: names that no row had before, case aside, with the most similar of the names there were, by a Ratcliff-Obershelp ratio of `ratio` or more, as other, and that ratio, times a thousand, as n. Null keys and names are no news."""
    tally = change_report(before, after.where(F.col(key).isNotNull()), key, entity).where("added > 0")
    none = F.lit(None).cast("string").alias("other")
    rows = lambda df, label: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit("total").alias("kind"), F.lit(label).alias("label"), "n", none)
    added = tally.orderBy(F.desc("added"), entity).limit(top).select(F.lit("added").alias("kind"), F.col(entity).cast("string").alias("label"), F.col("added").alias("n"), none)
    lower = lambda df: df.select(F.lower(name).alias("t")).where("t <> ''").distinct()
    old = lower(before)
    like = look_alikes(lower(after).join(old, "t", "left_anti"), old, ratio).groupBy("x").agg(F.max(F.struct("ratio", F.col("y").alias("y"))).alias("b"))
    return rows(before, "was").unionByName(rows(after, "now")).unionByName(added).unionByName(like.select(F.lit("look_alike").alias("kind"), F.col("x").alias("label"), F.round(F.col("b.ratio") * 10).cast("long").alias("n"), F.col("b.y").alias("other")))


def reconcile(current: DataFrame, incoming: DataFrame, key: str, fields: Mapping[str, Column | None]) -> DataFrame:
    """(key, status, field, mine, theirs): new and missing keys, and fields that differ. fields: name to the normal form values are compared in (of a column x), null to compare as they are. A field that the source leaves empty says nothing."""
    a = current.select(F.col(key), F.struct(*[F.col(c).cast("string").alias(c) for c in fields]).alias("a"))
    b = incoming.select(F.col(key), F.struct(*[F.col(c).cast("string").alias(c) for c in fields]).alias("b"))
    met = a.join(b, key, "full")
    row = lambda status, c, mine, theirs: F.struct(F.lit(status).alias("status"), F.lit(c).cast("string").alias("field"), mine.cast("string").alias("mine"), theirs.cast("string").alias("theirs"))
    changed = []
    for c, normal in fields.items():
        x, y = F.col(f"a.{c}"), F.col(f"b.{c}")
        f = normal or (lambda v: v)
        changed.append(F.when(y.isNotNull() & ~f(x).eqNullSafe(f(y)), row("changed", c, x, y)))
    none = F.lit(None)
    found = F.when(F.col("a").isNull(), F.array(row("new", None, none, none))).when(F.col("b").isNull(), F.array(row("missing", None, none, none))).otherwise(F.array_compact(F.array(*changed)))
    return met.select(key, F.inline(found))


def backfill_unambiguous(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value) of keys with one value only. Smallest and largest value tell, so no set of values is gathered."""
    g = df.groupBy(key).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    return g.where("lo = hi").select(key, F.col("lo").alias(value))


# --- merges ----------------------------------------------------------------------------------

def follow(links: DataFrame, a: str, b: str) -> DataFrame:
    """Links with each chain followed to its end, however long; b is null where the chain runs into a cycle and so has none.

    The reach doubles each round. Links that still move after as many rounds as it takes to reach through all of them
    stand before a cycle or on one.
    """
    now = cut(links.select(a, b))
    for _ in range(now.count().bit_length() + 1):
        far = now.select(F.col(a).alias(b), F.col(b).alias("far_"))
        now = cut(now.join(far, b, "left").select(a, F.coalesce("far_", b).alias(b), F.col("far_").isNotNull().alias("moved_")))
        if now.where("moved_").isEmpty():
            return now.select(a, b)
        last, now = now, now.drop("moved_")
    return last.select(a, F.when(~F.col("moved_"), F.col(b)).alias(b))


def alias_rows(moved: DataFrame, aliases: DataFrame, entity: str, spelling: str) -> DataFrame:
    """(entity, alias): every spelling that moved rows came with, as it will be looked up (lower case, trimmed), that is no alias of the entity yet. Null and blank spellings: none."""
    plain = lambda df, c: df.select(entity, F.lower(F.trim(c)).alias("alias")).where("alias <> ''").distinct()
    return plain(moved, spelling).join(plain(aliases, "alias"), [entity, "alias"], "left_anti")


def validate_merges(merges: DataFrame, dim: DataFrame, a: str, b: str, key: str, owner: str, ext: str | None = None) -> DataFrame:
    """Add reason: self, unknown, owner (the two belong to different ones), ids (they carry different external ids), twice (merged into several) or null for a merge that may be made."""
    side = lambda c, n: dim.select(F.col(key).alias(c), F.col(owner).alias(f"o{n}_"), (F.col(ext) if ext else F.lit(None)).cast("string").alias(f"x{n}_"), F.lit(True).alias(f"in{n}_"))
    targets = merges.groupBy(F.col(a).alias("t_")).agg((F.min(b) < F.max(b)).alias("twice_"))
    met = merges.join(side(a, "a"), a, "left").join(side(b, "b"), b, "left").join(targets, F.col(a) == F.col("t_"), "left")
    reason = (
        F.when(F.col(a) == F.col(b), "self").when(F.col("ina_").isNull() | F.col("inb_").isNull(), "unknown").when(~F.col("oa_").eqNullSafe(F.col("ob_")), "owner")
        .when(F.col("xa_") != F.col("xb_"), "ids").when(F.col("twice_"), "twice")
    )
    return met.select(*merges.columns, reason.alias("reason"))


def resolve_collisions(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Of rows that a merge gave one key, the first in the order stays."""
    return df.withColumn("nth_", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("nth_ = 1").drop("nth_")


def journal(before: DataFrame, after: DataFrame, key: str, fields: Sequence[str], batch: str) -> DataFrame:
    """(key, field, old, new, batch): one row per changed field of rows in both, one with a null field per row that is gone or new."""
    pack = lambda df, name: df.select(F.col(key), F.struct(*[F.col(c).cast("string").alias(c) for c in fields]).alias(name))
    met = pack(before, "a").join(pack(after, "b"), key, "full")
    row = lambda c, x, y: F.struct(F.lit(c).cast("string").alias("field"), x.cast("string").alias("old"), y.cast("string").alias("new"))
    changed = [F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), row(c, F.col(f"a.{c}"), F.col(f"b.{c}"))) for c in fields]
    one_sided = F.array(row(None, F.to_json("a"), F.to_json("b")))
    rows = F.when(F.col("a").isNull() | F.col("b").isNull(), one_sided).otherwise(F.array_compact(F.array(*changed)))
    return met.select(key, F.inline(rows)).withColumn("batch", F.lit(batch))


def undo(current: DataFrame, journal_: DataFrame, key: str, fields: Sequence[str], batch: str) -> DataFrame:
    """(key, fields, refused): current with a batch reversed exactly as the journal says: changed fields go back, rows that went come back, rows that came go.

    refused: the row was changed again since and stays as it is. A row that went and is there again is left as it is.
    """
    kinds = {c: current.schema[c].dataType.simpleString() for c in fields}
    j = journal_.where(F.col("batch") == batch)
    change = lambda c: F.max(F.when(F.col("field") == c, F.struct("old", "new"))).alias(f"{c}_j")
    one_sided = F.col("field").isNull()
    by_key = j.groupBy(key).agg(*[change(c) for c in fields], F.max(F.when(one_sided, F.struct("old", "new"))).alias("row_j"))
    met = current.select(key, *fields, F.lit(True).alias("in_")).join(by_key, key, "full")
    now = F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in fields]))
    came, went = F.col("row_j").isNotNull() & F.col("row_j.old").isNull(), F.col("row_j.old").isNotNull()
    moved = F.lit(False)
    for c in fields:
        moved = moved | F.coalesce(F.col(f"{c}_j").isNotNull() & ~F.col(c).cast("string").eqNullSafe(F.col(f"{c}_j.new")), F.lit(False))
    here = F.col("in_").isNotNull()
    refused = here & (moved | went | (came & (now != F.col("row_j.new"))))
    met = met.withColumn("refused", F.coalesce(refused, F.lit(False))).where(~(came & (~here | ~F.col("refused"))) & (here | went))
    old = F.from_json("row_j.old", ", ".join(f"{c} string" for c in fields))
    value = lambda c: F.when(~here, old[c].cast(kinds[c])).when(~F.col("refused") & F.col(f"{c}_j").isNotNull(), F.col(f"{c}_j.old").cast(kinds[c])).otherwise(F.col(c)).alias(c)
    return met.select(key, *[value(c) for c in fields], "refused")


# --- tags ------------------------------------------------------------------------------------

def pick_for_fill(votes: DataFrame, entity: str, tag: str, n: str, umbrellas: Sequence[str], k: int = 3, least: int = 2) -> DataFrame:
    """Up to k tags of an entity with `least` votes or more; umbrella tags only where no specific one qualifies."""
    enough = votes.where(F.col(n) >= least).withColumn("wide_", F.col(tag).isin(*umbrellas))
    w = Window.partitionBy(entity)
    fit = enough.withColumn("only_", F.min("wide_").over(w)).where("not wide_ or only_")
    return fit.withColumn("nth", F.row_number().over(w.orderBy(F.desc(n), tag))).where(F.col("nth") <= k).select(entity, tag, n, "nth")


def apply_source(current: DataFrame, incoming: DataFrame, entity: str, tag: str, source: str, priority: Mapping[str, int], hidden: DataFrame) -> DataFrame:
    """Tags (entity, tag, source) after a source has spoken anew: what it no longer says goes, what it says comes unless hidden, and a tag said by several keeps the source of highest priority."""
    keep = current.where(F.col("source") != source)
    said = incoming.select(entity, tag).distinct().join(hidden.select(entity, tag).distinct(), [entity, tag], "left_anti").withColumn("source", F.lit(source))
    rank = F.coalesce(*[F.when(F.col("source") == s, p) for s, p in priority.items()], F.lit(-1))
    return keep.select(entity, tag, "source").unionByName(said).groupBy(entity, tag).agg(F.max_by("source", F.struct(rank, "source")).alias("source"))


def apply_rules(tags: DataFrame, rules: DataFrame, entity: str, tag: str, hops: int = 8) -> DataFrame:
    """Tags by the rules (tag, target): a target replaces the tag, along chains of `hops` links at most, so that a cycle ends there; a null target hides it."""
    merges = rules.where(F.col("target").isNotNull()).groupBy(F.col(tag).alias("from_")).agg(F.min("target").alias("to_"))
    now = tags.select(entity, F.col(tag).alias("end_"))
    for _ in range(hops):
        now = now.join(merges, F.col("end_") == F.col("from_"), "left").select(entity, F.coalesce("to_", "end_").alias("end_"))
    hidden = rules.where(F.col("target").isNull()).select(F.col(tag).alias("end_"))
    return now.join(hidden, "end_", "left_anti").select(entity, F.col("end_").alias(tag)).distinct()


def ordered_tags(votes: DataFrame, entity: str, tag: str, n: str) -> DataFrame:
    """(entity, tags): the entity's tags in one string, most votes first, ties by name."""
    each = F.array_sort(F.collect_list(F.struct((-F.col(n)).alias("m"), F.col(tag).alias("t"))))
    return votes.groupBy(entity).agg(F.array_join(F.transform(each, lambda x: x["t"]), ", ").alias("tags"))


# --- checks ----------------------------------------------------------------------------------

def constraint_checks(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """(check, n): rows that break each rule, in one scan."""
    row = df.agg(*[F.count_if(bad).alias(f"c{i}") for i, bad in enumerate(rules.values())])
    return row.select(F.inline(F.array(*[F.struct(F.lit(name).alias("check"), F.col(f"c{i}").alias("n")) for i, name in enumerate(rules)])))


def worsened(before: DataFrame, after: DataFrame) -> DataFrame:
    """Checks (check, n) that more rows break than before."""
    return after.join(before.select("check", F.col("n").alias("was")), "check", "left").where("n > coalesce(was, 0)").select("check", F.coalesce("was", F.lit(0)).alias("was"), "n")


def reference_edition(df: DataFrame, group: str, order: Sequence[Column], keep: Sequence[str]) -> DataFrame:
    """One row per group, the first in the order, by an aggregate instead of a sort of the group."""
    best = F.min_by(F.struct(*keep), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])).alias("b_")
    return df.groupBy(group).agg(best).select(group, *[F.col(f"b_.{c}").alias(c) for c in keep])
