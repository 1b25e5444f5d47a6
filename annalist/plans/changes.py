"""Queries over batches of changes, checks and fuzzy matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from annalist.operators import batches as B
from annalist.operators import curation as C
from annalist.operators import lists as L
from annalist.operators import matching as M
from annalist.operators import releases as RL
from annalist.operators import similar as N2
from annalist.plans.registry import QUERIES, query


def unchecked(f):
    """A query without SQL: the tests hold its operator against a plain version."""
    QUERIES[f.__name__] = lambda spark, d: f(lambda name: spark.read.parquet(f"{d}/{name}.parquet"))
    return f


# --- batches ---------------------------------------------------------------------------------

@query("""SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'X' || c_nationkey ELSE c_mktsegment END AS c_mktsegment, CASE WHEN c_custkey % 6 = 0 THEN 7 ELSE c_nationkey END AS c_nationkey FROM customer""")
def m7_edit_fields(t):
    c = t("customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    changes = c.where("c_custkey % 4 = 0").selectExpr("c_custkey", "'c_mktsegment' as field", "'X' || c_nationkey as new").union(c.where("c_custkey % 6 = 0").selectExpr("c_custkey", "'c_nationkey'", "'7'")).union(c.selectExpr("-c_custkey", "'c_nationkey'", "'1'"))
    return B.edit_fields(c, changes, "c_custkey", ["c_mktsegment", "c_nationkey"], "b")[0]


@query("""SELECT c_custkey, 'c_mktsegment' AS field, c_mktsegment AS old, 'X' || c_nationkey AS new, 'b' AS batch FROM customer WHERE c_custkey % 4 = 0 UNION ALL SELECT c_custkey, 'c_nationkey', c_nationkey::VARCHAR, '7', 'b' FROM customer WHERE c_custkey % 6 = 0 AND c_nationkey <> 7""")
def m7_edit_journal(t):
    c = t("customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    changes = c.where("c_custkey % 4 = 0").selectExpr("c_custkey", "'c_mktsegment' as field", "'X' || c_nationkey as new").union(c.where("c_custkey % 6 = 0").selectExpr("c_custkey", "'c_nationkey'", "'7'"))
    return B.edit_fields(c, changes, "c_custkey", ["c_mktsegment", "c_nationkey"], "b")[1]


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_suppkey % 5 = 0 AND l_returnflag = 'R' THEN l_suppkey + 1 WHEN l_suppkey % 7 = 0 THEN 1 ELSE l_suppkey END AS l_suppkey, (l_suppkey % 5 = 0 AND l_returnflag = 'R') OR (l_suppkey % 7 = 0 AND l_suppkey <> 1) AS moved FROM lineitem""")
def m9_move_facts(t):
    s = t("supplier")
    moves = s.where("s_suppkey % 5 = 0").selectExpr("s_suppkey source", "'r' raw", "s_suppkey + 1 target").union(s.where("s_suppkey % 7 = 0").selectExpr("s_suppkey", "cast(null as string)", "cast(1 as bigint)"))
    return B.move_facts(t("lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag"), moves, "l_suppkey", "l_returnflag").drop("l_returnflag")


@query("""WITH moved AS (SELECT l_orderkey, CASE WHEN l_suppkey = 3 THEN NULL WHEN l_suppkey = 4 THEN 5 ELSE l_suppkey END AS s FROM lineitem), n AS (SELECT (SELECT count(*) FROM moved WHERE s IS NULL) AS a)
SELECT 'unfiled' AS "check", 0::BIGINT AS was, a AS n FROM n WHERE a > 0""")
def m11_run_batch(t):
    """A batch of two moves, one of which loses the parent of some lines: the gate says which check got worse."""
    step = lambda old, new: lambda tables: {"lines": tables["lines"].withColumn("l_suppkey", F.when(F.col("l_suppkey") == old, new).otherwise(F.col("l_suppkey")))}
    checks = lambda tables: tables["lines"].agg(F.count_if(F.col("l_suppkey").isNull()).alias("n")).select(F.lit("unfiled").alias("check"), "n")
    return B.run_batch({"lines": t("lineitem").select("l_orderkey", "l_suppkey")}, [step(3, None), step(4, 5)], checks)[1]


@query("""WITH d AS (SELECT l_orderkey AS p, l_partkey AS i FROM lineitem GROUP BY ALL), plan AS (SELECT o_orderkey AS small, o_orderkey + 1 AS big FROM orders WHERE o_orderkey % 2 = 0), x AS (SELECT small, min(big) AS big FROM (SELECT small, big FROM plan JOIN d ON d.p = small LEFT JOIN d e ON e.p = big AND e.i % 5 = d.i % 5 GROUP BY 1, 2 HAVING count(DISTINCT d.i % 5) = count(DISTINCT CASE WHEN e.i IS NOT NULL THEN d.i % 5 END)) GROUP BY 1)
SELECT coalesce(big, l_orderkey) AS l_orderkey, l_linenumber, big IS NOT NULL AS folded FROM lineitem LEFT JOIN x ON small = l_orderkey""")
def m13_fold_releases(t):
    """Orders whose kinds of parts the next order has too are folded into it."""
    lines = t("lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 5).alias("item"))
    plan = t("orders").where("o_orderkey % 2 = 0").selectExpr("o_orderkey small", "o_orderkey + 1 big")
    return B.fold_releases(lines, plan, "l_orderkey", "item").drop("item")


@query("""SELECT count(*) AS n, count(DISTINCT k) AS keys, min(k) AS lo, max(k) AS hi FROM (SELECT s_suppkey AS k FROM supplier UNION ALL SELECT (SELECT max(s_suppkey) FROM supplier) + row_number() OVER () FROM (SELECT DISTINCT p_type FROM part))""")
def m14_add_entities(t):
    dim = t("supplier").select("s_suppkey", F.col("s_name").alias("name"))
    out, _ = B.add_entities(dim, t("part").select(F.col("p_type").alias("name")).union(dim.select("name")), "s_suppkey", "name")
    return out.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("s_suppkey").alias("keys"), F.min("s_suppkey").alias("lo"), F.max("s_suppkey").alias("hi"))


@query("""SELECT DISTINCT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b FROM lineitem WHERE l_partkey <> l_suppkey AND l_returnflag IN ('R', 'A')
EXCEPT SELECT least(l_partkey, l_suppkey), greatest(l_partkey, l_suppkey) FROM lineitem WHERE l_returnflag = 'N' AND l_linenumber = 1""")
def m14_change_links(t):
    flag = lambda c: t("lineitem").where(c).select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"))
    return B.change_links(flag("l_returnflag = 'R'"), flag("l_returnflag = 'A'").select(F.col("b").alias("a"), F.col("a").alias("b")), flag("l_returnflag = 'N' and l_linenumber = 1"))


_CATALOGUE = """i AS (SELECT p_partkey AS item, p_name AS title, p_size AS actor, p_partkey % 40 AS parent FROM part), p AS (SELECT DISTINCT parent FROM i UNION SELECT 1000), c AS (SELECT DISTINCT parent, actor FROM i WHERE item % 3 > 0), f AS (SELECT l_partkey AS item, CASE WHEN l_orderkey % 500 = 0 THEN -1 ELSE actor END AS actor FROM lineitem JOIN i ON item = l_partkey WHERE l_partkey % 11 > 0)"""


@query(f"""WITH {_CATALOGUE}, r AS (SELECT 'no_credit' AS "check", 'hard' AS severity, parent AS id, NULL AS label FROM p WHERE parent NOT IN (SELECT parent FROM c)
UNION ALL SELECT 'other_actor', 'hard', f.item, min(f.actor::VARCHAR) FROM f JOIN i USING (item) WHERE f.actor <> i.actor GROUP BY f.item
UNION ALL SELECT 'uncredited', 'soft', item, title FROM i WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.parent = i.parent AND c.actor = i.actor)
UNION ALL SELECT 'same_title', 'soft', min(item), lower(title) FROM i GROUP BY actor, lower(title) HAVING count(*) > 1
UNION ALL SELECT 'orphans', 'soft', item, title FROM i WHERE item NOT IN (SELECT item FROM f))
SELECT "check", severity, count(*) AS n, array_to_string(list(id::VARCHAR || coalesce(':' || label, '') ORDER BY id, label NULLS FIRST)[1:50], '|') AS samples FROM r GROUP BY 1, 2""")
def q2_q3_integrity_report(t):
    items = t("part").select(F.col("p_partkey").alias("item"), F.col("p_name").alias("title"), F.col("p_size").alias("actor"), (F.col("p_partkey") % 40).alias("parent"))
    parents = items.select("parent").union(t("region").where("r_regionkey = 0").selectExpr("cast(1000 as bigint)")).distinct()
    credits = items.where("item % 3 > 0").select("parent", "actor").distinct()
    facts = t("lineitem").where("l_partkey % 11 > 0").select(F.col("l_partkey").alias("item"), "l_orderkey").join(items.select("item", "actor"), "item").select("item", F.expr("case when l_orderkey % 500 = 0 then -1 else actor end").alias("actor"))
    report = B.integrity_report(B.consistency_checks(parents, credits, items, facts, {"parent": "parent", "actor": "actor", "item": "item", "title": "title"}))
    first = F.array_sort("samples", lambda x, y: F.coalesce(F.nullif(x["id"].cast("long") - y["id"].cast("long"), F.lit(0)), F.when(x["label"] < y["label"], -1).otherwise(1)).cast("int"))
    return report.select("check", "severity", "n", F.array_join(F.transform(first, lambda x: F.concat(x["id"], F.coalesce(F.concat(F.lit(":"), x["label"]), F.lit("")))), "|").alias("samples"))


# --- matching --------------------------------------------------------------------------------

@unchecked
def s14_pair_scores(t):
    """Ratios of the names of neighbouring parts."""
    p = t("part").select("p_partkey", F.lower("p_name").alias("x"))
    return M.pair_scores(p.join(p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("x").alias("y")), "p_partkey"), "x", "y")


@unchecked
def d5_parent_pairs(t):
    """Parts of a brand with near names, and how many suppliers' names, as their lists, one has of the other's, near ones too."""
    parents = t("part").select(F.col("p_partkey").alias("key"), F.lower("p_name").alias("title"), F.col("p_brand").alias("owner"))
    lists = t("lineitem").select(F.col("l_partkey").alias("parent"), "l_suppkey").distinct().join(t("supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.lower("s_name").alias("title")), "l_suppkey").select("parent", "title")
    return L.list_overlap(lists, M.fuzzy_pairs(parents, "key", "title", 90, "owner"), 97)


@unchecked
def d6_actor_pairs(t):
    """Parts whose names have nearly the same words, and how many suppliers both have."""
    actors = t("part").select(F.col("p_partkey").alias("key"), F.expr("p_name || case p_partkey % 4 when 0 then ' and the ' || p_type when 1 then '' else ' ' || p_brand end").alias("name"), F.expr("case when p_partkey % 3 = 0 then p_size end").alias("ext"))
    titles = t("lineitem").select(F.col("l_partkey").alias("key"), F.col("l_suppkey").cast("string").alias("title"))
    return M.actor_pairs(actors, "key", "name", "ext", titles=titles)


@unchecked
def j12_word_sets(t):
    """Names with nearly the same words, among all of them."""
    return N2.word_set_pairs(t("part").select(F.lit("").alias("block"), F.expr("lower(p_name || ' ' || p_type || case when p_partkey % 2 = 0 then ' ' || p_brand else '' end)").alias("t")))


@unchecked
def d4_similar_versions(t):
    """Hints at parts of one size whose names, with a type or a brand besides, have nearly the same words."""
    p = t("part").select("p_partkey", "p_size", F.expr("lower(p_name || case p_partkey % 3 when 0 then '' when 1 then ' ' || p_type else ' the ' || p_brand end)").alias("k"), F.expr("p_partkey % 2").alias("sequel"))
    return M.similar_versions(p, "p_partkey", "p_size", "k", "sequel")


@unchecked
def d2_possible_pairs(t):
    """Parts of one size whose names are likely one: some run together, some with an article, a year or a letter more."""
    title = F.expr("case p_partkey % 7 when 0 then replace(p_name, ' ', '') when 1 then 'The ' || p_name when 2 then p_name || ' \\'95' when 3 then p_name || 's' when 4 then p_name || ' Pt. 2' else p_name end")
    return M.possible_pairs(t("part").select("p_partkey", "p_size", title.alias("title")), "p_partkey", "p_size", "title")


@unchecked
def d12_match_track_lists(t):
    """Lines of each order against items that carry their names with a blank less, a word more, a letter more or another's id; the first line of every fifth order is linked by hand."""
    p = t("part").select(F.col("p_partkey").alias("l_partkey"), F.lower("p_name").alias("k"), "p_type")
    rows = t("lineitem").where("l_linenumber is not null").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey")).join(p, "l_partkey")
    lines = rows.select(F.col("l_orderkey").alias("parent"), F.col("l_linenumber").cast("long").alias("line"), F.initcap("k").alias("title"), F.col("k").alias("key"), F.expr("case when l_partkey % 3 = 0 then 'i' || l_linenumber end").alias("id"))
    key = F.expr("case (l_partkey + l_linenumber) % 5 when 0 then k when 1 then replace(k, ' ', '') when 2 then k || ' ' || lower(p_type) when 3 then substr(k, 1, 4) || substr(k, 4) else lower(p_type) end")
    items = rows.select(F.col("l_orderkey").alias("parent"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("item"), key.alias("key"), F.expr("case when l_partkey % 7 = 0 then 'i' || (l_linenumber + 1) end").alias("id"))
    links = lines.where("parent % 5 = 0 and line = 1").select("parent", "title", (F.col("parent") * 10 + 2).alias("item"))
    return L.match_lists(lines, items, links)


@unchecked
def a15_look_alikes(t):
    """Names of customers and suppliers that came with the newer half of the parts' names, and older ones that look like them."""
    n = lambda c: t("part").where(c).select(F.expr("lower(p_name || ' ' || p_type)").alias("name"), F.col("p_partkey").alias("id"), F.col("p_brand").alias("entity"))
    old, new = n("p_partkey % 2 = 0"), t("part").select(F.expr("case when p_partkey % 2 = 0 then lower(p_name || ' ' || p_type) else lower(substr(p_name, 1, 3) || substr(p_name, 3) || ' ' || p_type) end").alias("name"), F.col("p_partkey").alias("id"), F.col("p_brand").alias("entity"))
    return C.refresh_report(old, new, "id", "entity", "name")


@unchecked
def d7_nearest(t):
    """The newer half of the parts against the older."""
    p = t("part").select(F.col("p_partkey").alias("key"), F.lower("p_name").alias("title"), "p_brand")
    return M.nearest(p.where("key % 2 = 1"), p.where("key % 2 = 0"), "key", "title", 84, 8, "p_brand")


def _lists(t):
    """The suppliers' names that stand on each part's list."""
    return t("lineitem").select(F.col("l_partkey").alias("parent"), "l_suppkey").distinct().join(t("supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.lower("s_name").alias("title")), "l_suppkey").select("parent", "title")


def _near(t):
    """Which of the suppliers' names are near each other."""
    return L.near_titles(t("supplier").select(F.lower("s_name").alias("title")), 97)


def _named(t):
    """Parts as members of their brand and size."""
    return t("part").where("p_brand is not null and p_size is not null").select(F.to_json(F.struct("p_brand", "p_size")).alias("block"), F.col("p_partkey").alias("key"), F.lower("p_name").alias("text"))


@unchecked
def e14_score_actors(t):
    """Parts of one brand and size as candidates for one another's names, scored by their own lists; every third has no list to look up."""
    met = L.overlap_within(_named(t), _lists(t).where("parent % 3 > 0"), _near(t))
    met = met.select(F.col("a").alias("entity"), F.col("b").alias("candidate"), "ratio", "alike", (100 - F.abs(F.col("a") - F.col("b")) % 60).alias("search"), F.expr("case when n_a > 0 then n_a end").alias("titles"), F.expr("case when n_b > 0 then shared end").alias("matched"))
    return M.score_actors(met, "entity")


@unchecked
def e15_score_parents(t):
    """Parts of one brand and size as candidates for one another, scored by the share of a part's list that the candidate's has, near titles too."""
    parts, listed, near = _named(t), _lists(t), _near(t)
    met = lambda members, *carry: L.overlap_within(members, listed, near, carry).select(F.col("a").alias("entity"), F.col("b").alias("candidate"), "ratio", F.col("n_a").alias("played"), F.expr("case when n_b > 0 then shared end").alias("matched"), F.expr("b % 6 = 0").alias("conflict"), *carry)
    # Only parts of one name can be strong candidates.
    strong = M.strong_parents(met(parts.withColumn("block", F.to_json(F.struct("block", "text")))), "entity").withColumnRenamed("entity", "key")
    return M.score_parents(met(parts.join(strong, "key", "left"), "strong"), "entity")


@unchecked
def f11_fuzzy_search(t):
    """Every part's name, and its first word, looked up among the parts."""
    p = t("part").select("p_partkey", F.lower("p_name").alias("title"), F.col("p_size").cast("long").alias("weight"))
    queries = t("part").select(F.lower(F.split("p_name", " ")[0]).alias("query")).union(p.select("title"))
    return M.fuzzy_search(queries, p, "p_partkey", "title", "weight")


@unchecked
def d11_contained_releases(t):
    """Orders as releases of a twentieth of the customers each, parts' names as tracks, titled by their first line; every seventh order's list is known, and every third part was looked up."""
    p = t("part").select(F.col("p_partkey").alias("l_partkey"), F.lower("p_name").alias("base"), (F.col("p_size") > 5).alias("plain"))
    rows = t("lineitem").join(p, "l_partkey").join(t("orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_custkey") % 200).alias("owner"), "o_totalprice", "o_orderdate", "o_orderstatus"), "l_orderkey")
    rows = rows.select(F.col("l_orderkey").alias("parent"), "owner", F.col("l_partkey").alias("item"), F.concat_ws("|", "base", F.col("plain").cast("string")).alias("track"), "base", "plain", "l_linenumber", "o_totalprice", "o_orderdate", "o_orderstatus")
    parents = rows.groupBy("parent", "owner").agg(F.min_by("base", F.struct("l_linenumber", "item")).alias("title_key"), F.expr("case when max(o_totalprice) > 200000 then 'x' end").alias("ext"), F.year(F.max("o_orderdate")).alias("year"), (F.max("o_orderstatus") == "P").alias("unsuitable"), F.expr("parent % 10 div 9").alias("owned"), F.expr("parent % 13 = 0").alias("is_album"), F.expr("parent % 17 = 0").alias("varied"), F.expr("parent % 19 = 0").alias("edition"))
    filed = rows.where("item % 4 > 0").select("parent", "owner", "item", "track", "base", "plain").distinct()
    plays = rows.groupBy("parent", "owner", "track", "base", "plain").agg(F.count(F.lit(1)).alias("n"))
    return RL.contained_releases(parents, parents.select("parent", "owner"), filed, plays, rows.where("parent % 7 = 0").select("parent", "track").distinct(), rows.where("item % 3 = 0").select("owner", "track", "parent").distinct())[0]
