"""Queries over the small filters, joins and sorts."""

from __future__ import annotations

from pyspark.sql import functions as F

from annalist.operators import relational as R
from annalist.plans.registry import query


@query("SELECT event_id, coalesce(lower(trim(event_type)) IN ('click', 'unknown'), false) AS flagged FROM events")
def f2_flag_values(t):
    return R.flag_values(t("events"), "event_type", ["Click", "unknown"]).select("event_id", "flagged")


@query("SELECT p_partkey FROM part WHERE length(p_name) >= 11 AND length(p_type) >= 6")
def f6_min_length(t):
    return R.min_length(R.min_length(t("part"), ["p_name"], 11), ["p_type"], 6).select("p_partkey")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag NOT IN ('R', 'A') AND l_suppkey IS DISTINCT FROM l_partkey")
def f7_exclude_values(t):
    return R.exclude_values(R.exclude_values(t("lineitem"), "l_returnflag", ["R", "A"]), "l_suppkey", [-1], "l_partkey").select("l_orderkey", "l_linenumber")


@query("SELECT doc_id, regexp_matches(h, '^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$') AS valid FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN m ELSE m[1:8] || '-' || m[9:12] || '-' || m[13:16] || '-' || m[17:20] || '-' || m[21:] END AS h FROM (SELECT doc_id, md5(source) AS m FROM documents))")
def f9_valid_id(t):
    m = F.md5("source")
    uuid = F.concat_ws("-", *[F.substring(m, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    return R.valid_id(t("documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, m).otherwise(F.upper(uuid)).alias("h")), "h").select("doc_id", "valid")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 150000)")
def j4_semi(t):
    return R.where_exists(t("customer"), t("orders").where("o_totalprice > 150000").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey").select("c_custkey")


_PARTS = "SELECT n_nationkey AS whole, n_nationkey + 25 AS part FROM nation WHERE n_regionkey = 1 UNION ALL SELECT n_nationkey, n_nationkey + 50 FROM nation WHERE n_regionkey < 3"


@query(f"WITH b AS (SELECT n_nationkey AS whole, n_nationkey AS part FROM nation UNION {_PARTS}) SELECT c_custkey, part AS scope FROM customer JOIN b ON c_nationkey = whole")
def j13_expand_scope(t):
    n = t("nation")
    parts = n.where("n_regionkey = 1").selectExpr("n_nationkey whole", "n_nationkey + 25 part").union(n.where("n_regionkey < 3").selectExpr("n_nationkey", "n_nationkey + 50"))
    return R.expand_scope(t("customer"), parts, "c_nationkey", "whole", "part").select("c_custkey", "scope")


@query("SELECT o_orderkey AS l_orderkey, o_custkey AS actor FROM orders UNION SELECT l_orderkey, l_suppkey FROM lineitem")
def j14_credited(t):
    return R.credited(t("orders").withColumnRenamed("o_orderkey", "l_orderkey"), t("lineitem").withColumnRenamed("l_suppkey", "actor"), "l_orderkey", "o_custkey", "actor")


@query("SELECT l_orderkey, l_linenumber, n_name, r_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def j1_star_dims(t):
    out = R.star(t("lineitem"), [(t("supplier"), "l_suppkey", "s_suppkey"), (t("nation"), "s_nationkey", "n_nationkey"), (t("region"), "n_regionkey", "r_regionkey")])
    return out.select("l_orderkey", "l_linenumber", "n_name", "r_name")


@query("""WITH c AS (SELECT DISTINCT l_partkey AS item, l_suppkey AS actor FROM lineitem WHERE l_suppkey % 3 > 0), g AS (SELECT actor, p_type AS tag, count(DISTINCT item) AS items FROM c JOIN part ON p_partkey = item GROUP BY 1, 2)
SELECT * FROM g UNION ALL SELECT s_suppkey, n_name, 0 FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey NOT IN (SELECT actor FROM g)""")
def ag10_rollup_tags(t):
    tags = t("part").selectExpr("p_partkey item", "p_type tag")
    credits = t("lineitem").where("l_suppkey % 3 > 0").selectExpr("l_partkey item", "l_suppkey actor")
    fallback = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).selectExpr("s_suppkey actor", "n_name tag")
    return R.rollup_tags(tags, credits, "item", "actor", "tag", fallback)


@query("SELECT c_custkey, coalesce(n, 0) * 5 + coalesce(c_acctbal, 0) * 50 AS weight FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def ag15_weight(t):
    n = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    return R.weight(t("customer").join(n, "c_custkey", "left"), {"n": 5, "c_acctbal": 50}).select("c_custkey", "weight")


@query("SELECT p_partkey, rank() OVER (ORDER BY coalesce(CASE WHEN p_size % 4 > 0 THEN p_size END, 9999) DESC, coalesce(p_type, '') ASC) AS place FROM part QUALIFY row_number() OVER (ORDER BY coalesce(CASE WHEN p_size % 4 > 0 THEN p_size END, 9999) DESC, coalesce(p_type, ''), p_partkey) <= 100")
def t1_sort_by(t):
    p = t("part").withColumn("size", F.expr("case when p_size % 4 > 0 then p_size end"))
    first = p.orderBy(*R.sort_key([("size", True, 9999), ("p_type", False, "")]), "p_partkey").limit(100)  # a page is the feature
    ties = first.groupBy("size", "p_type").agg(F.count(F.lit(1)).alias("n"))
    x, y = ties.alias("x"), ties.alias("y")
    key = lambda a: F.struct(-F.coalesce(F.col(f"{a}.size"), F.lit(9999)), F.coalesce(F.col(f"{a}.p_type"), F.lit("")))
    place = x.join(y, key("y") < key("x"), "left").groupBy("x.size", "x.p_type").agg((F.coalesce(F.sum("y.n"), F.lit(0)) + 1).alias("place"))
    return first.join(place, first["size"].eqNullSafe(place["size"]) & first["p_type"].eqNullSafe(place["p_type"])).select("p_partkey", "place")


@query("SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 2 END AS place FROM orders")
def t5_order_tiers(t):
    return R.order_tiers(t("orders"), "o_orderpriority", "o_totalprice", ("1-URGENT", "2-HIGH")).select("o_orderkey", "place")


@query("SELECT o_custkey AS grp, arg_min(o_orderkey, (CASE WHEN coalesce(o_orderstatus = 'F', false) THEN 0 ELSE 1 END, -n, year(o_orderdate), o_orderkey)) AS list FROM orders JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey GROUP BY 1")
def w12_best_list(t):
    n = t("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))
    lists = t("orders").join(n, "o_orderkey").select(F.col("o_custkey").alias("grp"), F.col("o_orderkey").alias("list"), (F.col("o_orderstatus") == "F").alias("original"), "n", F.year("o_orderdate").alias("y"))
    return R.best_list(lists, "grp", "original", "n", "y")
