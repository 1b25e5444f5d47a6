"""Queries over the entity, duplicate, placement, review and tag operators, and further joins, windows and sorts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from annalist.functions import times
from annalist.operators import entities as N
from annalist.operators import relational as R
from annalist.plans.registry import query
from annalist.sources import tables
from annalist.streaming import streams

def rows():
    return F.count(F.lit(1))


# --- resolving -------------------------------------------------------------------------------

@query("""WITH s AS (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN c_nationkey + 1000 END AS ext, CASE WHEN c_custkey % 11 <> 0 THEN replace(upper(c_name), 'CUSTOMER', 'The Supplier') END AS name FROM customer),
d AS (SELECT s_suppkey AS entity, s_nationkey + 1000 AS ext, trim(regexp_replace(lower(s_name), '[^a-z0-9]+', ' ', 'g')) AS k FROM supplier),
m AS (SELECT s.*, CASE WHEN c_custkey % 7 = 0 AND name IS NOT NULL THEN c_custkey % 3 END AS e1, (SELECT min(entity) FROM d WHERE d.ext = s.ext) AS e2, (SELECT min(entity) FROM d WHERE d.k = trim(regexp_replace(replace(lower(name), 'the ', ''), '[^a-z0-9]+', ' ', 'g'))) AS e3 FROM s)
SELECT c_custkey, CASE WHEN e1 IS NOT NULL THEN 'alias' WHEN e2 IS NOT NULL THEN 'id' WHEN e3 IS NOT NULL THEN 'name' WHEN name IS NOT NULL THEN 'new' END AS how, coalesce(e1, e2, e3) AS known, e1 IS NULL AND e2 IS NULL AND e3 IS NULL AND name IS NOT NULL AS fresh FROM m""")
def e1_resolve(t):
    """Customers as sightings of suppliers. Numbers of new entities are tested apart; here they only have to lie after the known ones."""
    name = F.when(F.col("c_custkey") % 11 != 0, F.regexp_replace(F.upper("c_name"), "CUSTOMER", "The Supplier"))
    s = t("customer").select("c_custkey", F.when(F.col("c_custkey") % 5 == 0, F.col("c_nationkey") + 1000).alias("ext"), name.alias("name"))
    dim = t("supplier").select(F.col("s_suppkey").alias("entity"), (F.col("s_nationkey") + 1000).alias("ext"), F.col("s_name").alias("name"))
    aliases = s.where("c_custkey % 7 = 0").select(F.col("name").alias("alias"), (F.col("c_custkey") % 3).alias("entity"))
    fresh = (F.col("how") == "new") & (F.col("entity") > F.col("top"))
    top = dim.agg(F.max("entity").alias("top"))
    out = N.resolve(s, dim, aliases, "c_custkey", "ext", "name").crossJoin(F.broadcast(top))
    return out.select("c_custkey", "how", F.when(F.col("how") != "new", F.col("entity")).alias("known"), F.coalesce(fresh, F.lit(False)).alias("fresh"))


@query("SELECT count(DISTINCT p_name) AS n, 1 AS lo, count(DISTINCT p_name) AS hi FROM part")
def e1_numbered(t):
    """New numbers are consecutive."""
    return N.numbered(t("part"), "p_name", "nth").agg(F.countDistinct("nth").alias("n"), F.min("nth").alias("lo"), F.max("nth").alias("hi"))


@query("""WITH seen AS (SELECT DISTINCT l_partkey AS id, l_suppkey % 10 AS list FROM lineitem), lists AS (SELECT p_partkey AS id, p_size % 10 AS list, CASE WHEN p_size % 3 = 0 THEN 'slot' ELSE 'item' END AS kind FROM part WHERE p_partkey % 2 = 0), direct AS (SELECT p_partkey AS id, 'item' AS kind FROM part WHERE p_partkey % 5 = 0)
SELECT id, coalesce((SELECT max(kind) FROM seen x JOIN lists l ON x.id = l.id AND x.list = l.list WHERE x.id = s.id), (SELECT min(kind) FROM direct d WHERE d.id = s.id), 'unknown') AS kind FROM (SELECT DISTINCT id FROM seen) s""")
def e4_classify_ids(t):
    seen = t("lineitem").select(F.col("l_partkey").alias("id"), (F.col("l_suppkey") % 10).alias("list"))
    lists = t("part").where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("id"), (F.col("p_size") % 10).cast("long").alias("list"), F.when(F.col("p_size") % 3 == 0, "slot").otherwise("item").alias("kind"))
    direct = t("part").where("p_partkey % 5 = 0").select(F.col("p_partkey").alias("id"), F.lit("item").alias("kind"))
    return N.classify_ids(seen, lists, direct, "id", "list")


@query("SELECT key, string_agg(DISTINCT ext, ',' ORDER BY ext) AS ids FROM (SELECT s_suppkey AS key, s_name AS ext FROM supplier UNION ALL SELECT l_suppkey, l_returnflag FROM lineitem) GROUP BY 1")
def e8_id_sets(t):
    dim = t("supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("ext"))
    aliases = t("lineitem").select(F.col("l_suppkey").alias("key"), F.col("l_returnflag").alias("ext"))
    return N.id_sets(dim, aliases, "key", "ext").select("key", F.array_join("ids", ",").alias("ids"))


@query("""WITH d AS (SELECT p_partkey AS key, CASE WHEN p_partkey % 3 = 0 THEN p_size END AS ext FROM part), c AS (SELECT DISTINCT p_partkey AS key, (p_size + p_partkey % 2 * 7) % 90 AS ext FROM part),
m AS (SELECT c.key, c.ext, d.ext AS mine, c.ext NOT IN (SELECT ext FROM d WHERE ext IS NOT NULL) AND d.ext IS NULL AS free FROM c JOIN d USING (key)), r AS (SELECT *, row_number() OVER (PARTITION BY ext, free ORDER BY key) AS p FROM m)
SELECT key, ext, CASE WHEN mine = ext THEN 'same' WHEN free AND p = 1 THEN 'filled' ELSE 'clash' END AS outcome FROM r""")
def e9_backfill_ids(t):
    p = t("part")
    dim = p.select(F.col("p_partkey").alias("key"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_size")).cast("long").alias("ext"))
    claims = p.select(F.col("p_partkey").alias("key"), ((F.col("p_size") + F.col("p_partkey") % 2 * 7) % 90).alias("ext"))
    return N.backfill_ids(dim, claims, "key", "ext")


@query("""SELECT DISTINCT l_returnflag || l_linestatus AS kind, l_suppkey AS subject, l_returnflag = 'N' AS settled FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM lineitem o WHERE o.l_quantity > 49 AND o.l_suppkey = lineitem.l_suppkey AND o.l_returnflag = lineitem.l_returnflag AND o.l_linestatus = lineitem.l_linestatus)""")
def e10_record_findings(t):
    f = t("lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("kind"), F.col("l_suppkey").alias("subject"), "l_quantity")
    return N.record_findings(f.select("kind", "subject"), f.where("l_quantity > 49"), ["kind", "subject"], ["NO", "NF"])


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN p_partkey IS NULL THEN 'gone' WHEN p_size = l_suppkey THEN 'agrees' ELSE 'open' END AS state FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_partkey % 4 <> 0) ON p_partkey = l_partkey""")
def e11_settle(t):
    live = t("part").where("p_partkey % 4 <> 0").select(F.col("p_partkey").alias("l_partkey"), "p_size")
    return N.settle(t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), live, "l_partkey", "p_size", "l_suppkey")


@query("""WITH e AS (SELECT p_partkey AS a, p_size AS b, p_size AS score, CASE WHEN p_size % 4 = 0 THEN 'rejected' WHEN p_size % 4 = 1 THEN 'accepted' ELSE 'open' END AS status FROM part WHERE p_partkey % 3 <> 0), n AS (SELECT p_partkey AS a, p_size AS b, p_size + 1 AS score FROM part WHERE p_partkey % 2 = 0)
SELECT coalesce(e.a, n.a) AS a, coalesce(e.b, n.b) AS b, CASE WHEN coalesce(status, 'open') = 'open' THEN coalesce(n.score, e.score) ELSE e.score END AS score, coalesce(status, 'open') AS status FROM e FULL JOIN n ON e.a = n.a AND e.b = n.b""")
def e16_upsert_suggestions(t):
    p = t("part").select(F.col("p_partkey").alias("a"), F.col("p_size").alias("b"), F.col("p_size").alias("score"))
    status = F.when(F.col("b") % 4 == 0, "rejected").when(F.col("b") % 4 == 1, "accepted").otherwise("open")
    return N.upsert_suggestions(p.where("a % 3 <> 0").withColumn("status", status), p.where("a % 2 = 0").withColumn("score", F.col("score") + 1), ["a", "b"], "score")


# --- near duplicates, placement --------------------------------------------------------------

@query("""WITH n AS (SELECT p_brand AS block, p_name || ' ' || p_type AS text, min(p_partkey) AS id FROM part GROUP BY 1, 2)
SELECT a.id AS a, b.id AS b, a.block, round(1 - levenshtein(a.text, b.text) / greatest(length(a.text), length(b.text)), 4) AS similarity FROM n a JOIN n b ON a.block = b.block AND a.id < b.id
WHERE levenshtein(a.text, b.text) * 100 <= greatest(length(a.text), length(b.text)) * 20 AND (a.id + b.id) % 10 <> 0""")
def d2_near_pairs(t):
    """Parts of a brand whose name and type are nearly equal; pairs whose keys add up to a multiple of ten were dismissed."""
    p = t("part").select("p_partkey", "p_brand", F.concat_ws(" ", "p_name", "p_type").alias("text"))
    out = N.near_pairs(p, "p_partkey", "text", 80, "p_brand")
    return N.near_pairs(p, "p_partkey", "text", 80, "p_brand", dismissed=out.where((F.col("a") + F.col("b")) % 10 == 0).select("a", "b"))


@query("""WITH n AS (SELECT p_name AS text, min(p_partkey) AS id FROM part GROUP BY 1)
SELECT a.id AS a, b.id AS b, '' AS block, round(1 - levenshtein(a.text, b.text) / greatest(length(a.text), length(b.text)), 4) AS similarity FROM n a JOIN n b ON a.id < b.id WHERE levenshtein(a.text, b.text) * 100 <= greatest(length(a.text), length(b.text)) * 30""")
def j12_near_names(t):
    return N.near_pairs(t("part"), "p_partkey", "p_name", 70)


@query("""SELECT p_brand, p_name, count(*) AS n, min(p_partkey) AS least, max(p_partkey) AS most, (array_agg(p_partkey ORDER BY CASE WHEN p_type = 'PROMO' THEN 0 ELSE 1 END, p_size DESC, p_partkey))[1] AS "primary" FROM part GROUP BY 1, 2 HAVING count(*) > 1""")
def d3_review_groups(t):
    order = [F.when(F.col("p_type") == "PROMO", 0).otherwise(1), -F.col("p_size"), F.col("p_partkey")]
    return N.review_groups(t("part"), ["p_brand", "p_name"], "p_partkey", order)


@query("""WITH f AS (SELECT l_partkey % 50 AS item, l_suppkey AS parent, s2.s_name AS raw FROM lineitem JOIN supplier s2 ON s2.s_suppkey = l_partkey % 10), p AS (SELECT s_suppkey AS parent, s_nationkey % 3 AS owner, s_name FROM supplier),
o AS (SELECT owner, s_name, min(parent) AS target FROM p GROUP BY 1, 2 HAVING count(*) = 1), w AS (SELECT f.parent, target, count(*) AS n, count(DISTINCT item) AS items FROM f JOIN p USING (parent) JOIN o ON o.owner = p.owner AND o.s_name = f.raw WHERE target <> f.parent GROUP BY 1, 2), z AS (SELECT parent, count(DISTINCT item) AS s FROM f GROUP BY 1)
SELECT w.parent, target, n, items, coalesce(items * 100 >= t.s * 60 AND items * 100 <= h.s * 34, false) AS strong FROM w JOIN z h ON h.parent = w.parent LEFT JOIN z t ON t.parent = target""")
def d9_misfiled(t):
    names = t("supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("raw"))
    f = t("lineitem").select((F.col("l_partkey") % 50).alias("item"), F.col("l_suppkey").alias("parent"), (F.col("l_partkey") % 10).alias("k")).join(names, "k")
    p = t("supplier").select(F.col("s_suppkey").alias("parent"), (F.col("s_nationkey") % 3).alias("owner"), "s_name")
    return N.misfiled(f, p, "item", "parent", "raw", "owner", "s_name")


@query("""WITH i AS (SELECT l_partkey AS item, l_suppkey AS parent, l_partkey % 5 AS owner, count(*) AS n FROM lineitem GROUP BY 1, 2, 3), c AS (SELECT s_suppkey AS parent, s_nationkey % 5 AS owner FROM supplier),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY n DESC, parent) AS r FROM i) WHERE r = 1)
SELECT f.item, f.parent, (SELECT x.parent FROM i x JOIN c ON c.parent = x.parent AND c.owner = x.owner WHERE x.item = f.item ORDER BY x.n DESC, x.parent LIMIT 1) AS better FROM f LEFT JOIN c ON c.parent = f.parent AND c.owner = f.owner WHERE c.parent IS NULL""")
def d10_misplaced(t):
    items = t("lineitem").select(F.col("l_partkey").alias("item"), F.col("l_suppkey").alias("parent"), (F.col("l_partkey") % 5).alias("owner")).groupBy("item", "parent", "owner").agg(rows().alias("n"))
    credits = t("supplier").select(F.col("s_suppkey").alias("parent"), (F.col("s_nationkey") % 5).cast("long").alias("owner"))
    return N.misplaced(items, credits, "item", "parent", "owner")


@query("""WITH l AS (SELECT p_brand AS parent, p_partkey AS line, p_name AS title FROM part WHERE p_partkey % 2 = 0), i AS (SELECT p_brand AS parent, p_partkey AS item, upper(p_name) AS title FROM part WHERE p_partkey % 2 = 1),
la AS (SELECT *, lower(title) AS k, row_number() OVER (PARTITION BY parent, lower(title) ORDER BY line) AS r FROM l), ia AS (SELECT *, lower(title) AS k, row_number() OVER (PARTITION BY parent, lower(title) ORDER BY item) AS r FROM i), h1 AS (SELECT la.parent, line, item FROM la JOIN ia USING (parent, k, r)),
lb AS (SELECT *, split_part(lower(title), ' ', 1) AS k, row_number() OVER (PARTITION BY parent, split_part(lower(title), ' ', 1) ORDER BY line) AS r FROM l WHERE line NOT IN (SELECT line FROM h1)), ib AS (SELECT *, split_part(lower(title), ' ', 1) AS k, row_number() OVER (PARTITION BY parent, split_part(lower(title), ' ', 1) ORDER BY item) AS r FROM i WHERE item NOT IN (SELECT item FROM h1))
SELECT parent, line, item, 'title' AS rule FROM h1 UNION ALL SELECT lb.parent, line, item, 'first word' FROM lb JOIN ib USING (parent, k, r)""")
def d12_match_lists(t):
    p = t("part").select(F.col("p_brand").alias("parent"), F.col("p_partkey").alias("k"), F.col("p_name").alias("title"))
    lines = p.where("k % 2 = 0").withColumnRenamed("k", "line")
    items = p.where("k % 2 = 1").withColumnRenamed("k", "item").withColumn("title", F.upper("title"))
    return N.match_lists(lines, items, "parent", "line", "item", "title", {"title": F.lower("title"), "first word": F.split_part(F.lower("title"), F.lit(" "), F.lit(1))})


# --- review ----------------------------------------------------------------------------------

@query("""SELECT c_custkey, (50 * (c_nationkey % 3) + 5 * coalesce(n, 0))::BIGINT AS weight FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey WHERE c_acctbal <= 5000 AND c_custkey % 10 <> 0""")
def q9_missing_queue(t):
    n = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(rows().alias("n"))
    c = t("customer").withColumns({"owned": F.col("c_nationkey") % 3, "rich": F.when(F.col("c_acctbal") > 5000, True)}).join(n, "c_custkey", "left")
    return N.missing_queue(c, "rich", "c_custkey", {"owned": 50, "n": 5}, t("customer").where("c_custkey % 10 = 0"))


@query("""SELECT o_custkey, CASE WHEN gaps > 0 THEN 'needs work' WHEN o_custkey % 3 = 0 THEN 'unreviewed' WHEN n <> old THEN 'changed' ELSE 'reviewed' END AS status
FROM (SELECT o_custkey, count(*) AS n, count(*) FILTER (o_orderdate < TIMESTAMP '2001-01-01') AS old, count(*) FILTER (o_totalprice > 390000) AS gaps FROM orders GROUP BY 1)""")
def q7_review_status(t):
    """Customers were reviewed before 2001; the signature stands for the set of their orders."""
    sign = lambda df: df.groupBy("o_custkey").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("o_orderkey")).cast("array<string>"), ","), 256).alias("sign"), F.count_if(F.col("o_totalprice") > 390000).alias("gaps"))
    o = t("orders")
    marks = sign(o.where("o_orderdate < timestamp_ntz'2001-01-01'")).where("o_custkey % 3 <> 0").drop("gaps")
    rest = o.select("o_custkey").distinct().where("o_custkey % 3 <> 0").join(marks, "o_custkey", "left")
    return N.review_status(sign(o), rest, "o_custkey", "sign", "gaps").select("o_custkey", "status")


@query("SELECT l_linenumber AS run, count(DISTINCT l_returnflag || l_suppkey::VARCHAR) AS questions, count(DISTINCT l_suppkey) AS subjects, count(DISTINCT l_returnflag) AS kinds FROM lineitem WHERE l_linestatus <> 'F' GROUP BY 1")
def q10_inbox(t):
    f = t("lineitem").select(F.col("l_linenumber").alias("run"), F.col("l_returnflag").alias("kind"), F.col("l_suppkey").alias("subject"), (F.col("l_linestatus") == "F").alias("settled"))
    return N.inbox(f, "run", "kind", "subject")


# --- edits -----------------------------------------------------------------------------------

@query("""WITH c AS (SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN NULL WHEN p_size % 4 = 1 THEN p_brand ELSE 'Brand#0' END AS value FROM part WHERE p_partkey % 3 <> 0), m AS (SELECT p.p_partkey, CASE WHEN p_size % 5 <> 0 THEN p_brand END AS brand, p_size > 45 AS manual, c.p_partkey IS NOT NULL AS hit, value FROM part p LEFT JOIN c USING (p_partkey)),
s AS (SELECT *, CASE WHEN manual THEN 'manual' WHEN NOT hit THEN 'pending' WHEN value IS NULL THEN 'notfound' WHEN brand IS NULL THEN 'set' WHEN brand = value THEN 'same' ELSE 'change' END AS status FROM m) SELECT p_partkey, status, CASE WHEN status IN ('set', 'change') THEN value ELSE brand END AS filled FROM s""")
def m12_fill_from_cache(t):
    p = t("part")
    value = F.when(F.col("p_size") % 4 == 1, F.col("p_brand")).when(F.col("p_size") % 4 != 0, "Brand#0")
    df = p.select("p_partkey", F.when(F.col("p_size") % 5 != 0, F.col("p_brand")).alias("brand"), (F.col("p_size") > 45).alias("manual"))
    return N.fill_from_cache(df, p.where("p_partkey % 3 <> 0").select("p_partkey", value.alias("value")), "p_partkey", "brand", "manual").select("p_partkey", "status", "filled")


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_suppkey % 2 = 1 AND l_returnflag = 'R' THEN l_suppkey + 900000 WHEN l_suppkey % 2 = 1 AND l_returnflag = 'A' THEN 2 ELSE l_suppkey END AS l_suppkey, l_suppkey % 2 = 1 AND l_returnflag IN ('R', 'A') AS moved FROM lineitem")
def m8_split_out(t):
    """Lines of every second supplier flagged R go to a new one of its own, those flagged A to supplier 2."""
    odd = t("supplier").where("s_suppkey % 2 = 1")
    splits = odd.selectExpr("s_suppkey parent", "'r' raw", "s_suppkey + 900000 target").union(odd.selectExpr("s_suppkey", "'a'", "cast(2 as bigint)"))
    return N.split_out(t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"), "l_suppkey", "l_returnflag", splits).drop("l_returnflag")


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN o_custkey % 4 = 0 AND l_partkey % 3 = 0 AND o_custkey IN (SELECT c_custkey FROM customer) AND l_partkey IN (SELECT p_partkey FROM part) THEN l_partkey + 1000000 ELSE l_partkey END AS l_partkey, coalesce(o_custkey % 4 = 0 AND l_partkey % 3 = 0, false) AS moved FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey""")
def m10_relink_lines(t):
    lines = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    events = t("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    seen = lines.join(events, "l_orderkey").select("o_custkey", "l_partkey").distinct()
    mapping = seen.where("o_custkey % 4 = 0 and l_partkey % 3 = 0").withColumn("target", F.col("l_partkey") + 1000000)
    return N.relink_lines(lines, events, "l_orderkey", "o_custkey", "l_partkey", mapping)


@query("""WITH l AS (SELECT p_brand AS parent, p_name AS k, CASE WHEN p_size % 3 <> 0 THEN p_size END AS len FROM part), i AS (SELECT parent, k, min(len) AS m FROM l WHERE len IS NOT NULL GROUP BY 1, 2)
SELECT parent, count(*) AS lines, count(coalesce(len, m)) AS known, CASE WHEN count(*) = count(coalesce(len, m)) THEN sum(coalesce(len, m)) END::BIGINT AS total FROM l LEFT JOIN i USING (parent, k) GROUP BY 1""")
def m16_fill_lengths(t):
    l = t("part").select(F.col("p_brand").alias("parent"), F.col("p_name").alias("k"), F.when(F.col("p_size") % 3 != 0, F.col("p_size")).alias("len"))  # noqa: E741
    return N.fill_lengths(l, l, "parent", "k", "len")


# --- tags ------------------------------------------------------------------------------------

@query("""WITH t AS (SELECT DISTINCT p_brand AS entity, p_name AS tag, length(p_brand) + p_size % 1 AS owner FROM part), n AS (SELECT count(DISTINCT entity) AS n FROM t), w AS (SELECT tag, ln(1 + any_value(n) / count(*)) AS w FROM t, n GROUP BY 1),
s AS (SELECT a.entity, b.entity AS other, round(sum(w), 6) AS score FROM t a JOIN w USING (tag) JOIN t b USING (tag) WHERE a.owner <> b.owner AND b.entity IN (SELECT p_brand FROM part WHERE p_size > 45) GROUP BY 1, 2)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY score DESC, other) AS nth FROM s) WHERE nth <= 5""")
def gn11_similar_by_tags(t):
    """For every brand, brands like it by shared part names; the owner of a brand is the length of its name, and used are those with a part over size 45."""
    tags = t("part").select(F.col("p_brand").alias("entity"), F.col("p_name").alias("tag"), F.length("p_brand").alias("owner"))
    return N.similar_by_tags(tags, "entity", "tag", "owner", tags, 5, t("part").where("p_size > 45").select(F.col("p_brand").alias("entity")))


@query("SELECT p_type AS tag, count(DISTINCT p_brand) AS entities, count(DISTINCT p_size) AS sources, count(DISTINCT CASE WHEN p_brand IN (SELECT p_brand FROM part WHERE p_retailprice > 915) THEN p_brand END) AS owned FROM part GROUP BY 1")
def gn9_tag_index(t):
    tags = t("part").select("p_brand", F.col("p_type").alias("tag"), "p_size")
    return N.tag_index(tags, "p_brand", "tag", "p_size", t("part").where("p_retailprice > 915"))


@query("""WITH s AS (SELECT p_brand, p_name AS tag, 'own' AS why FROM part WHERE p_size < 20 UNION SELECT p_brand, p_name, 'style' FROM part WHERE p_size > 15)
SELECT p_brand, tag, string_agg(why, ', ' ORDER BY why) AS reasons FROM s WHERE NOT EXISTS (SELECT 1 FROM part h WHERE h.p_brand = s.p_brand AND h.p_name = s.tag AND (h.p_type = 'PROMO' OR h.p_size = 17)) GROUP BY 1, 2""")
def gn10_suggest_tags(t):
    said = lambda where: t("part").where(where).select("p_brand", F.col("p_name").alias("tag"))
    return N.suggest_tags({"own": said("p_size < 20"), "style": said("p_size > 15")}, said("p_type = 'PROMO'"), said("p_size = 17"), "p_brand", "tag")


# --- further joins, aggregates, windows, sorts -----------------------------------------------

@query("SELECT o.o_orderkey, (SELECT count(*) FROM events e WHERE e.user_id = o.o_custkey) AS plays FROM orders o")
def j3_with_stats(t):
    stats = t("events").groupBy(F.col("user_id").alias("o_custkey")).agg(rows().alias("plays"))
    return t("orders").join(stats, "o_custkey", "left").select("o_orderkey", F.coalesce("plays", F.lit(0)).alias("plays"))


@query("""SELECT user_id, count(*) FILTER (ts < f) AS before, count(*) FILTER (ts >= f) AS since FROM events JOIN (SELECT user_id, min(ts) AS f FROM events WHERE event_type = 'purchase' GROUP BY 1) USING (user_id) GROUP BY 1""")
def j7_since_first(t):
    """Events of each user before and since the first purchase, with the first one found by a partial aggregate."""
    e = t("events").where("user_id is not null")
    first = e.where("event_type = 'purchase'").groupBy("user_id").agg(F.min("ts").alias("f"))
    return e.join(first, "user_id").groupBy("user_id").agg(F.count_if(F.col("ts") < F.col("f")).alias("before"), F.count_if(F.col("ts") >= F.col("f")).alias("since"))


@query("SELECT o_orderkey, lag(o_orderkey) OVER w AS previous, lead(o_orderkey) OVER w AS next FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def j8_neighbours(t):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return t("orders").select("o_orderkey", F.lag("o_orderkey").over(w).alias("previous"), F.lead("o_orderkey").over(w).alias("next"))


@query("SELECT event_id, user_id, nth FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS nth FROM events) WHERE nth IN (1, 10)")
def w2_nth_occurrence(t):
    return R.nth_occurrence(t("events"), ["user_id", "event_type"], [F.asc("ts"), F.asc("event_id")], (1, 10)).select("event_id", "user_id", "nth")


@query("SELECT p_partkey, 1 + (SELECT count(*) FROM part q WHERE q.p_retailprice > part.p_retailprice) AS rank FROM part")
def w4_overall_rank(t):
    return R.with_rank(t("part").select("p_partkey", "p_retailprice"), "p_retailprice").select("p_partkey", "rank")


@query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS nth, count(*) OVER (PARTITION BY o_custkey) AS of, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate, o_orderkey) AS nth_here FROM orders")
def w6_nth_of(t):
    by = lambda *c: F.row_number().over(Window.partitionBy(*c).orderBy("o_orderdate", "o_orderkey")).cast("long")
    return t("orders").select("o_orderkey", by("o_custkey").alias("nth"), F.count(F.lit(1)).over(Window.partitionBy("o_custkey")).alias("of"), by("o_custkey", "o_orderstatus").alias("nth_here"))


@query("SELECT p_brand, p_name, coalesce(p_type, 'Unknown') AS \"group\" FROM part")
def t2_group_listing(t):
    """Groups by size, within them by name; rows of no group come last."""
    return R.group_listing(t("part"), "p_type", [F.asc("p_name"), F.asc("p_partkey")]).select("p_brand", "p_name", "group")


@query("SELECT l_suppkey, min(l_shipdate) AS first, max(l_shipdate) AS last, count(*) AS n FROM lineitem GROUP BY 1")
def ag4_first_last(t):
    return t("lineitem").groupBy("l_suppkey").agg(F.min("l_shipdate").alias("first"), F.max("l_shipdate").alias("last"), rows().alias("n"))


@query("SELECT p_name, count(DISTINCT p_brand) AS brands FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) >= 2")
def ag7_having(t):
    return t("part").groupBy("p_name").agg(F.countDistinct("p_brand").alias("brands")).where("brands >= 2")


@query("SELECT p_brand, string_agg(p_name, ' | ' ORDER BY n DESC, p_name) AS top FROM (SELECT p_brand, p_name, count(*) AS n, row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, p_name) AS r FROM part GROUP BY 1, 2) WHERE r <= 4 GROUP BY 1")
def ag9_spellings(t):
    """The four most frequent spellings of each key."""
    n = t("part").groupBy("p_brand", "p_name").agg(rows().alias("n"))
    top = R.top_per_group(n, "p_brand", [F.desc("n"), F.asc("p_name")], 4)
    return top.groupBy("p_brand").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "p_name"))).alias("a")).select("p_brand", F.array_join("a.p_name", " | ").alias("top"))


@query("SELECT p_brand, string_agg(DISTINCT p_type, ', ' ORDER BY p_type) AS types FROM part GROUP BY 1")
def ag11_join_values(t):
    return t("part").groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_set("p_type")), ", ").alias("types"))


@query("SELECT year(o_orderdate) // 10 * 10 AS decade, month(o_orderdate) AS month, isodow(o_orderdate) AS weekday, grouping_id(year(o_orderdate) // 10 * 10, month(o_orderdate), isodow(o_orderdate)) AS g, count(*) AS n FROM orders GROUP BY GROUPING SETS ((year(o_orderdate) // 10 * 10), (month(o_orderdate)), (isodow(o_orderdate)))")
def ag13_tally(t):
    """Several tallies in one pass."""
    keys = [F.floor(F.year("o_orderdate") / 10).cast("long") * 10, F.month("o_orderdate").cast("long"), F.weekday("o_orderdate").cast("long") + 1]
    o = t("orders").select(*[k.alias(c) for k, c in zip(keys, ("decade", "month", "weekday"), strict=True)])
    return o.groupingSets([["decade"], ["month"], ["weekday"]], "decade", "month", "weekday").agg(F.grouping_id("decade", "month", "weekday").alias("g"), rows().alias("n"))


@query("SELECT (SELECT count(*) FROM events) AS plays, (SELECT count(DISTINCT user_id) FROM events) AS actors, (SELECT count(*) FROM orders) AS shows, (SELECT count(*) FROM part) AS works, (SELECT count(*) FROM events WHERE ts >= TIMESTAMP '2024-01-24') AS latest")
def ag16_totals(t):
    """Each table scanned once, one row of each joined."""
    e = t("events").agg(rows().alias("plays"), F.countDistinct("user_id").alias("actors"), F.count_if(F.col("ts") >= F.lit("2024-01-24").cast("timestamp_ntz")).alias("latest"))
    return e.crossJoin(t("orders").agg(rows().alias("shows"))).crossJoin(t("part").agg(rows().alias("works"))).select("plays", "actors", "shows", "works", "latest")


@query("SELECT p_brand, count(*) FILTER (p_size > 10) AS known, count(*) FILTER (p_size <= 10 AND p_size > 3) AS pending, count(*) AS n, round(100 * count(*) FILTER (p_size > 10) / count(*), 1) AS percent FROM part GROUP BY 1")
def ag17_coverage(t):
    known, pending = F.count_if(F.col("p_size") > 10), F.count_if((F.col("p_size") <= 10) & (F.col("p_size") > 3))
    return t("part").groupBy("p_brand").agg(known.alias("known"), pending.alias("pending"), rows().alias("n"), F.round(100 * known / rows(), 1).alias("percent"))


# --- compositions, sources and times over the given tables -----------------------------------

@query("""WITH c AS (SELECT o_custkey AS k, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_orderpriority END AS payload, o_orderdate FROM orders), l AS (SELECT k, o_orderdate AS f, max(payload) AS payload FROM c GROUP BY k, o_orderdate QUALIFY row_number() OVER (PARTITION BY k ORDER BY o_orderdate DESC) = 1)
SELECT c_custkey, CASE WHEN l.k IS NULL OR datediff('day', f::DATE, DATE '2001-08-01') > CASE WHEN payload IS NULL THEN 30 ELSE 180 END THEN 'missing' WHEN payload IS NULL THEN 'none' ELSE 'found' END AS state FROM customer LEFT JOIN l ON k = c_custkey""")
def a10_cache_lookup(t):
    """Orders as answers of a cache, those of status F empty."""
    c = t("orders").select(F.col("o_custkey").alias("c_custkey"), F.when(F.col("o_orderstatus") != "F", F.col("o_orderpriority")).alias("payload"), F.col("o_orderdate").alias("fetched_at"))
    return tables.cache_lookup(t("customer").select("c_custkey"), c, "c_custkey", "2001-08-01", 180, 30).select("c_custkey", "state")


@query("SELECT event_id, (props->>'$.k')::BIGINT + i AS v FROM events, generate_series(0, 1) AS s(i)")
def a12_explode_json(t):
    """The number in each event's JSON, and the one after it, by way of a JSON array."""
    n = F.get_json_object("props", "$.k").cast("long")
    e = t("events").select("event_id", F.format_string("[%d, %d]", n, n + 1).alias("list"))
    return tables.explode_json(e, "list", "bigint", "v")


@query("SELECT user_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events WHERE user_id IS NOT NULL) WHERE r = 1")
def x6_first_seen(t):
    e = t("events").where("user_id is not null").select("user_id", "ts", "event_id")
    return streams.first_seen(e, "user_id", "ts").withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))


@query("""SELECT event_type, count(*) FILTER (ts >= TIMESTAMP '2024-01-22' AND ts < TIMESTAMP '2024-01-29') AS now, count(*) FILTER (ts >= TIMESTAMP '2024-01-15' AND ts < TIMESTAMP '2024-01-22') AS before, round(count(*) FILTER (ts >= TIMESTAMP '2024-01-22' AND ts < TIMESTAMP '2024-01-29') / 3, 3) AS per_day FROM events GROUP BY 1""")
def s29_period_bounds(t):
    """The week of a Wednesday and the one before, and the average of its days so far."""
    e = t("events").withColumn("p", times.period_bounds("2024-01-24", "week"))
    now, before = (F.col("ts") >= F.col("p.start")) & (F.col("ts") < F.col("p.end")), (F.col("ts") >= F.col("p.previous")) & (F.col("ts") < F.col("p.start"))
    g = e.groupBy("event_type").agg(F.count_if(now).alias("now"), F.count_if(before).alias("before"), F.any_value("p").alias("p"))
    per = times.average_per(F.col("now"), F.col("p.start"), F.col("p.end"), F.lit("2024-01-25").cast("date"))
    return g.select("event_type", "now", "before", F.round(per, 3).alias("per_day"))


@query("""WITH a AS (SELECT o_orderkey AS id, 'merge' AS kind, o_orderdate AS "at" FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT l_orderkey, 'edit', max(l_shipdate) FROM lineitem GROUP BY 1) SELECT id, kind, "at" FROM a ORDER BY "at" DESC, kind, id LIMIT 200""")
def m15_activity(t):
    """A page of the newest entries of two histories."""
    merges = t("orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("at"))
    edits = t("lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.max("l_shipdate").alias("at"))
    return R.activity({"merge": merges, "edit": edits}, 200)


@query("""WITH n AS (SELECT s_nationkey AS city, s_suppkey AS place, coalesce(c, 0) AS c FROM supplier LEFT JOIN (SELECT l_suppkey, count(*) AS c FROM lineitem GROUP BY 1) ON l_suppkey = s_suppkey), b AS (SELECT city, place AS hall FROM (SELECT *, row_number() OVER (PARTITION BY city ORDER BY c DESC, place) AS r FROM n WHERE place % 3 <> 0) WHERE r = 1)
SELECT place, CASE WHEN place % 3 = 0 THEN coalesce(hall, place) ELSE place END AS folded FROM n LEFT JOIN b USING (city)""")
def p12_fold_places(t):
    """A stage (every third supplier) counts as the busiest place of its city that is none."""
    n = t("lineitem").groupBy(F.col("l_suppkey").alias("place")).agg(rows().alias("c"))
    p = t("supplier").select(F.col("s_suppkey").alias("place"), F.col("s_nationkey").alias("city"), (F.col("s_suppkey") % 3 == 0).alias("stage")).join(n, "place", "left")
    return N.fold_places(p, "place", "city", "stage", "c")


@query("""WITH s AS (SELECT DISTINCT o_custkey % 20 AS actor, l_partkey AS item FROM orders JOIN lineitem ON l_orderkey = o_orderkey), n AS (SELECT actor, count(*) AS n FROM s GROUP BY 1)
SELECT a.actor AS a, b.actor AS b, count(*) AS shared, any_value(x.n) AS of_a, any_value(y.n) AS of_b FROM s a JOIN s b USING (item) JOIN n x ON x.actor = a.actor JOIN n y ON y.actor = b.actor WHERE a.actor = 3 AND b.actor IN (5, 7) GROUP BY 1, 2""")
def p13_compare_actors(t):
    """Shared items of given pairs of actors, without pairing any others."""
    s = t("orders").join(t("lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select((F.col("o_custkey") % 20).alias("actor"), F.col("l_partkey").alias("item"))
    pairs = s.select(F.lit(3).cast("long").alias("a"), F.when(F.col("actor").isin(5, 7), F.col("actor")).alias("b")).where("b is not null").distinct()
    return N.compare_pairs(s, "actor", "item", pairs)


@query("""WITH m AS (SELECT p_brand, p_type, count(*) AS n, sum(p_size) AS w FROM part GROUP BY 1, 2), f AS (SELECT p_brand, p_type FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, w DESC, p_type) AS r FROM m) WHERE r = 1)
SELECT f.p_type AS tag, count(*) AS plays FROM lineitem JOIN part ON p_partkey = l_partkey JOIN f USING (p_brand) GROUP BY 1""")
def w1_main_tag_mix(t):
    """Each brand's main type, weighed by the lines of its parts."""
    p = t("part")
    tags = p.groupBy("p_brand", "p_type").agg(rows().alias("n"), F.sum("p_size").alias("w"))
    plays = t("lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(rows().alias("plays")).join(p.select("p_partkey", "p_brand"), "p_partkey")
    return R.main_tag_mix(plays, tags, "p_brand", "p_type", [F.desc("n"), F.desc("w")])
