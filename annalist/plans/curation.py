"""Queries over the curation and streaming operators, added to the registry's."""

from __future__ import annotations

from pyspark.sql import functions as F

from annalist.operators import curation as C
from annalist.operators import relational as R
from annalist.plans.registry import START, query
from annalist.streaming import streams as X


# --- sources, sets ---------------------------------------------------------------------------

@query("SELECT event_id, user_id FROM events WHERE ts > (SELECT max(ts) FROM events WHERE ts < TIMESTAMP '2024-01-20')")
def a6_since_watermark(t):
    have = t("events").where(F.col("ts") < F.lit("2024-01-20").cast("timestamp_ntz"))
    return C.since_watermark(t("events"), have, "ts").select("event_id", "user_id")


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN o_orderstatus = 'P' THEN l_quantity + 1 ELSE l_quantity END AS l_quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE NOT (o_orderstatus = 'P' AND l_linenumber = 1)""")
def a7_replace_by_key(t):
    lines = t("lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    open_ = t("orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    updates = lines.join(open_, "l_orderkey").where("l_linenumber <> 1").withColumn("l_quantity", F.col("l_quantity") + 1)
    return C.replace_by_key(lines, updates, ["l_orderkey"], deleted=open_)


@query("SELECT o_custkey, count(*) AS plays FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1 ORDER BY plays DESC, o_custkey LIMIT 100")
def a11_lookup_todo(t):
    o = t("orders")
    return C.lookup_todo(o.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("plays")), o.where("o_orderstatus = 'F'"), "o_custkey", "plays", 100)


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", '{k}' AS type, count(*) AS n, count(*) - count({c}) AS nulls FROM labels" for c, k in (("doc_id", "bigint"), ("quality", "int"), ("toxic", "int"))))
def a13_profile(t):
    return C.profile(t("labels"))


@query(f"SELECT user_id, count(*) FILTER (ts < TIMESTAMP '{START}') AS had, count(*) FILTER (ts >= TIMESTAMP '{START}') AS added FROM events GROUP BY 1")
def a15_change_report(t):
    return C.change_report(t("events").where(F.col("ts") < F.lit(START).cast("timestamp_ntz")), t("events"), "event_id", "user_id")


@query("""WITH a AS (SELECT * FROM part WHERE p_partkey % 11 <> 0), b AS (SELECT p_partkey, upper(p_name) AS p_name, CASE WHEN p_size % 5 = 0 THEN 'other' WHEN p_size % 5 = 1 THEN NULL ELSE p_brand END AS p_brand FROM part WHERE p_partkey % 13 <> 0)
SELECT p_partkey, 'new' AS status, NULL AS field, NULL AS mine, NULL AS theirs FROM b WHERE p_partkey NOT IN (SELECT p_partkey FROM a) UNION ALL SELECT p_partkey, 'missing', NULL, NULL, NULL FROM a WHERE p_partkey NOT IN (SELECT p_partkey FROM b)
UNION ALL SELECT p_partkey, 'changed', 'p_brand', a.p_brand, b.p_brand FROM a JOIN b USING (p_partkey) WHERE b.p_brand <> a.p_brand""")
def a16_reconcile(t):
    p = t("part")
    brand = F.when(F.col("p_size") % 5 == 0, "other").when(F.col("p_size") % 5 != 1, F.col("p_brand"))
    incoming = p.where("p_partkey % 13 <> 0").select("p_partkey", F.upper("p_name").alias("p_name"), brand.alias("p_brand"))
    return C.reconcile(p.where("p_partkey % 11 <> 0"), incoming, "p_partkey", {"p_name": F.lower, "p_brand": None})


@query("SELECT l_partkey, min(l_suppkey) AS l_suppkey FROM lineitem WHERE l_quantity >= 48 GROUP BY 1 HAVING count(DISTINCT l_suppkey) = 1")
def a17_backfill_unambiguous(t):
    return C.backfill_unambiguous(t("lineitem").where("l_quantity >= 48"), "l_partkey", "l_suppkey")


@query("SELECT l_partkey AS item FROM lineitem WHERE l_returnflag = 'R' UNION SELECT p_partkey FROM part WHERE p_size > 40")
def u1_union_distinct(t):
    return t("lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("item")).union(t("part").where("p_size > 40").select("p_partkey")).distinct()


@query("SELECT 'line' AS source, l_suppkey AS k, count(*) AS n FROM lineitem GROUP BY 2 UNION ALL SELECT 'part', p_size, count(*) FROM part GROUP BY 2")
def u2_union_all(t):
    count = lambda df, name, c: df.groupBy(F.col(c).cast("long").alias("k")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("source"), "k", "n")
    return count(t("lineitem"), "line", "l_suppkey").unionByName(count(t("part"), "part", "p_size"))


@query("SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'A' AND l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def u4_minus(t):
    lines = t("lineitem")
    return lines.where("l_returnflag = 'A'").select("l_orderkey").distinct().join(lines.where("l_returnflag = 'R'"), "l_orderkey", "left_anti")


# --- merges ----------------------------------------------------------------------------------

@query("SELECT absorbed, canonical FROM (SELECT p_partkey AS absorbed, p_size % 2 = 0 AS moves, max(CASE WHEN p_size % 2 = 1 OR NOT EXISTS (SELECT 1 FROM part q WHERE q.p_partkey = part.p_partkey - 1) THEN p_partkey END) OVER (ORDER BY p_partkey) AS canonical FROM part) WHERE absorbed <> canonical")
def m1_close_merges(t):
    """Each part of an even size was merged into the one before it, which may have gone the same way."""
    p = t("part").select("p_partkey", "p_size")
    merges = p.where("p_size % 2 = 0").select(F.col("p_partkey").alias("absorbed"), (F.col("p_partkey") - 1).alias("canonical"))
    merges = merges.join(p.select(F.col("p_partkey").alias("canonical")), "canonical", "left_semi")
    return C.follow(merges, "absorbed", "canonical")


@query("SELECT l_orderkey, item, l_linenumber, l_returnflag FROM (SELECT l_orderkey, l_partkey % 3 AS item, l_linenumber, l_returnflag, row_number() OVER (PARTITION BY l_orderkey, l_partkey % 3 ORDER BY CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END, l_linenumber, l_partkey) AS r FROM lineitem) WHERE r = 1")
def m2_resolve_collisions(t):
    lines = t("lineitem").withColumn("item", F.col("l_partkey") % 3)
    return C.resolve_collisions(lines, ["l_orderkey", "item"], [F.when(F.col("l_returnflag") == "R", 0).otherwise(1), F.asc("l_linenumber"), F.asc("l_partkey")]).select("l_orderkey", "item", "l_linenumber", "l_returnflag")


@query("""SELECT a.p_partkey AS absorbed, a.p_partkey - a.p_size % 3 AS canonical, CASE WHEN a.p_size % 3 = 0 THEN 'self' WHEN b.p_partkey IS NULL THEN 'unknown' WHEN a.p_brand <> b.p_brand THEN 'owner' END AS reason
FROM part a LEFT JOIN part b ON b.p_partkey = a.p_partkey - a.p_size % 3""")
def m3_validate_merges(t):
    merges = t("part").select(F.col("p_partkey").alias("absorbed"), (F.col("p_partkey") - F.col("p_size") % 3).alias("canonical"))
    return C.validate_merges(merges, t("part"), "absorbed", "canonical", "p_partkey", "p_brand")


@query("""SELECT DISTINCT l_partkey AS entity, lower(trim(l_linestatus)) AS alias FROM lineitem WHERE l_partkey % 5 = 0 EXCEPT SELECT l_partkey, lower(trim(l_linestatus)) FROM lineitem WHERE l_returnflag = 'N'""")
def m4_alias_rows(t):
    """Every spelling that moved rows come with and that is not an alias yet."""
    lines = t("lineitem").select(F.col("l_partkey").alias("entity"), F.col("l_linestatus").alias("alias"), "l_returnflag")
    return C.alias_rows(lines.where("entity % 5 = 0"), lines.where("l_returnflag = 'N'"), "entity", "alias")


def _edited(orders):
    return orders.withColumns({"o_orderstatus": F.when(F.col("o_orderkey") % 3 == 0, "F").otherwise(F.col("o_orderstatus")), "o_custkey": F.when(F.col("o_orderkey") % 5 == 0, 1).otherwise(F.col("o_custkey"))})


@query("""SELECT o_orderkey, 'o_orderstatus' AS field, o_orderstatus AS old, 'F' AS new, 'b1' AS batch FROM orders WHERE o_orderkey % 3 = 0 AND o_orderstatus <> 'F'
UNION ALL SELECT o_orderkey, 'o_custkey', o_custkey::VARCHAR, '1', 'b1' FROM orders WHERE o_orderkey % 5 = 0 AND o_custkey <> 1""")
def m5_journal(t):
    o = t("orders").select("o_orderkey", "o_orderstatus", "o_custkey")
    return C.journal(o, _edited(o), "o_orderkey", ["o_orderstatus", "o_custkey"], "b1")


@query("""WITH c AS (SELECT o_orderkey, o_orderstatus, o_custkey, o_orderkey % 7 = 0 AND o_orderkey % 11 <> 0 AS again, o_orderkey % 5 = 0 AND o_custkey <> 1 AS moved FROM orders WHERE o_orderkey > 0)
SELECT o_orderkey, CASE WHEN again AND moved AND o_orderkey % 3 = 0 THEN 'F' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN again THEN -2 ELSE o_custkey END AS o_custkey, again AND moved AS refused FROM c
UNION ALL SELECT -o_orderkey, 'N', 0, true FROM c WHERE o_orderkey % 91 = 0""")
def m6_undo(t):
    """A batch changed statuses and customers, dropped every eleventh order and added some; since then some customers moved on and some added orders changed. All that was left alone goes back."""
    o = t("orders").where("o_orderkey > 0").select("o_orderkey", "o_orderstatus", "o_custkey")  # its negative is another key
    added = o.where("o_orderkey % 13 = 0").selectExpr("-o_orderkey as o_orderkey", "'A' as o_orderstatus", "o_custkey")
    after = _edited(o).where("o_orderkey % 11 <> 0").unionByName(added)
    now = after.withColumn("o_custkey", F.expr("case when o_orderkey > 0 and o_orderkey % 7 = 0 then -2 when o_orderkey < 0 and o_orderkey % 7 = 0 then 0 else o_custkey end"))
    now = now.withColumn("o_orderstatus", F.expr("case when o_orderkey < 0 and o_orderkey % 7 = 0 then 'N' else o_orderstatus end"))
    return C.undo(now, C.journal(o, after, "o_orderkey", ["o_orderstatus", "o_custkey"], "b1"), "o_orderkey", ["o_orderstatus", "o_custkey"], "b1")


# --- tags, editions --------------------------------------------------------------------------

@query("""WITH v AS (SELECT p_brand, p_type AS tag, count(*) AS n FROM part GROUP BY 1, 2 HAVING count(*) >= 2), f AS (SELECT *, min(CASE WHEN tag IN ('ECONOMY', 'STANDARD') THEN 1 ELSE 0 END) OVER (PARTITION BY p_brand) AS only_wide FROM v)
SELECT p_brand, tag, n, nth FROM (SELECT p_brand, tag, n, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, tag) AS nth FROM f WHERE only_wide = 1 OR tag NOT IN ('ECONOMY', 'STANDARD')) WHERE nth <= 3""")
def gn2_pick_for_fill(t):
    votes = t("part").groupBy("p_brand", F.col("p_type").alias("tag")).agg(F.count(F.lit(1)).alias("n"))
    return C.pick_for_fill(votes, "p_brand", "tag", "n", ["ECONOMY", "STANDARD"]).withColumn("nth", F.col("nth").cast("long"))


@query("""WITH s AS (SELECT DISTINCT p_brand, p_type AS tag FROM part WHERE p_size > 25 AND p_size <= 45), m AS (SELECT DISTINCT p_brand, p_type AS tag FROM part WHERE p_size <= 10), h AS (SELECT DISTINCT p_brand, p_type AS tag FROM part WHERE p_size > 45)
SELECT p_brand, tag, CASE WHEN max(r) = 2 THEN 'manual' ELSE 'lookup' END AS source FROM (SELECT *, 1 AS r FROM (SELECT * FROM s EXCEPT SELECT * FROM h) UNION ALL SELECT *, 2 FROM m) GROUP BY 1, 2""")
def gn3_apply_source(t):
    said = lambda where, s: t("part").where(where).select("p_brand", F.col("p_type").alias("tag"), F.lit(s).alias("source")).distinct()
    current = said("p_size <= 10", "manual").union(said("p_size between 11 and 25", "lookup"))
    return C.apply_source(current, said("p_size between 26 and 45", ""), "p_brand", "tag", "lookup", {"manual": 2, "lookup": 1}, said("p_size > 45", ""))


@query("SELECT DISTINCT p_brand, CASE WHEN p_size BETWEEN 10 AND 14 THEN 14 ELSE p_size END::BIGINT AS tag FROM part WHERE p_size NOT BETWEEN 20 AND 22")
def gn4_apply_rules(t):
    """Sizes 10 to 13 each stand for the next one; 20 is 21, 21 is 22, and 22 is hidden."""
    rule = (F.col("tag") >= 10) & (F.col("tag") < 14) | F.col("tag").isin(20, 21)
    tags = t("part").select("p_brand", F.col("p_size").cast("long").alias("tag"))
    rules = tags.select("tag").distinct().where(rule | (F.col("tag") == 22)).select("tag", F.when(rule, F.col("tag") + 1).alias("target"))
    return C.apply_rules(tags, rules, "p_brand", "tag")


@query("SELECT o_custkey, string_agg(tag, ', ' ORDER BY n DESC, tag) AS tags FROM (SELECT o_custkey, o_orderpriority AS tag, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY 1")
def w13_ordered_tags(t):
    votes = t("orders").groupBy("o_custkey", F.col("o_orderpriority").alias("tag")).agg(F.count(F.lit(1)).alias("n"))
    return C.ordered_tags(votes, "o_custkey", "tag", "n")


@query("SELECT p_brand, p_partkey, p_name FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY CASE WHEN p_size > 25 THEN 0 ELSE 1 END, p_retailprice, p_partkey) AS r FROM part) WHERE r = 1")
def e20_reference_edition(t):
    order = [F.when(F.col("p_size") > 25, 0).otherwise(1), F.col("p_retailprice"), F.col("p_partkey")]
    return C.reference_edition(t("part"), "p_brand", order, ["p_partkey", "p_name"])


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 3")
def t7_latest(t):
    return R.top_per_group(t("events"), "user_id", [F.desc("ts"), F.desc("event_id")], 3).select("user_id", "event_id", "event_type")


@query("""SELECT * FROM (SELECT 'no name' AS "check", count(*) FILTER (c_name IS NULL OR c_name = '') AS n FROM customer UNION ALL SELECT 'in debt', count(*) FILTER (c_acctbal < 0) FROM customer UNION ALL SELECT 'odd segment', count(*) FILTER (c_mktsegment NOT IN ('BUILDING', 'MACHINERY')) FROM customer)""")
def q8_constraint_checks(t):
    return C.constraint_checks(t("customer"), {"no name": F.col("c_name").isNull() | (F.col("c_name") == ""), "in debt": F.col("c_acctbal") < 0, "odd segment": ~F.col("c_mktsegment").isin("BUILDING", "MACHINERY")})


# --- streaming operators, here over the whole table ------------------------------------------

@query("SELECT event_type, strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M') AS start, count(*) AS n FROM events GROUP BY 1, 2")
def x4_tumbling_counts(t):
    return X.rolling_counts(t("events"), ["event_type"], "ts", "1 hour").withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm"))


@query("SELECT event_type, strftime(d, '%Y-%m-%d') AS start, count(*) AS n FROM (SELECT event_type, unnest(generate_series(ts::DATE - INTERVAL 6 DAY, ts::DATE::TIMESTAMP, INTERVAL 1 DAY)) AS d FROM events) GROUP BY 1, 2")
def x5_rolling_counts(t):
    return X.rolling_counts(t("events"), ["event_type"], "ts", "7 days", "1 day").withColumn("start", F.date_format("start", "yyyy-MM-dd"))


@query("""WITH m AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b FROM events WHERE user_id IS NOT NULL), s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM m)
SELECT user_id, epoch_us(min(ts)) AS first, epoch_us(max(ts)) + 1800000000 AS until, count(*) AS n FROM s GROUP BY user_id, s""")
def x8_sessions(t):
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp")).alias(c)
    return X.sessions(t("events").where("user_id is not null"), "user_id", "ts").select("user_id", us("first"), us("until"), "n")
