"""Queries over resolving, tags of parents, catalogues and decisions. Parts are works, suppliers and customers places, lineitems sightings."""

from __future__ import annotations

from pyspark.sql import functions as F

from annalist.operators import resolving as S
from annalist.plans.registry import query

_SEEN = "SELECT p_partkey AS row, p_size AS actor, upper(p_name) || CASE WHEN p_partkey % 8 = 0 THEN ' xx' || p_partkey % 16 ELSE '!' END AS title, CASE WHEN p_partkey % 5 = 0 THEN 'e' || p_partkey % 300 END AS edition, CASE WHEN p_partkey % 7 = 0 THEN 'g' || p_partkey % 200 END AS grp FROM part"
_DIM = "SELECT p_partkey AS entity, p_size AS actor, p_name AS title, CASE WHEN p_partkey % 4 = 0 THEN 'g' || p_partkey % 250 END AS grp FROM part WHERE p_partkey % 3 = 0"


def from_sql(t, sql):
    """A stand-in made of one table by SQL that both sides run."""
    name = sql.split(" FROM ")[1].split()[0]
    df = t(name)
    where = sql.split(" WHERE ")[1] if " WHERE " in sql else "true"
    return df.where(where).selectExpr(*_split(sql[len("SELECT ") : sql.index(" FROM ")]))


def _split(columns: str) -> list[str]:
    """Column expressions of a select list, cut at commas outside brackets and quotes."""
    out, depth, quoted, last = [], 0, False, 0
    for i, c in enumerate(columns):
        quoted ^= c == "'"
        depth += (c in "([") - (c in ")]") if not quoted else 0
        if c == "," and not depth and not quoted:
            out.append(columns[last:i])
            last = i + 1
    return [x.strip() for x in [*out, columns[last:]]]


_FOLD = "trim(regexp_replace(lower({}), '[^a-z0-9_]+', ' ', 'g'))"
_KEY = f"actor || ':' || {_FOLD.format('title')}"


@query(f"""WITH s AS ({_SEEN}), d AS ({_DIM}), a AS (SELECT actor || ':' || lower(trim(title)) AS k, min(row % 50) AS e FROM s WHERE row % 9 = 0 GROUP BY 1), ed AS (SELECT edition AS k, min(row % 70) AS e FROM s WHERE edition IS NOT NULL AND row % 10 = 0 GROUP BY 1),
vg AS (SELECT edition AS k, min(d.entity) AS e FROM (SELECT edition, 'g' || row % 250 AS grp FROM s WHERE edition IS NOT NULL) x JOIN d USING (grp) GROUP BY 1), g AS (SELECT grp AS k, min(entity) AS e FROM d WHERE grp IS NOT NULL GROUP BY 1), n AS (SELECT {_KEY} AS k, min(entity) AS e FROM d GROUP BY 1)
SELECT row, CASE WHEN a.e IS NOT NULL THEN 'alias' WHEN ed.e IS NOT NULL THEN 'edition' WHEN vg.e IS NOT NULL THEN 'via group' WHEN g.e IS NOT NULL THEN 'group' WHEN n.e IS NOT NULL THEN 'title' ELSE 'new' END AS how, coalesce(a.e, ed.e, vg.e, g.e, n.e) AS known
FROM s LEFT JOIN a ON a.k = actor || ':' || lower(trim(title)) LEFT JOIN ed ON ed.k = edition LEFT JOIN vg ON vg.k = edition LEFT JOIN g ON g.k = grp LEFT JOIN n ON n.k = {_KEY}""")
def e2_resolve_child(t):
    s, d = from_sql(t, _SEEN), from_sql(t, _DIM)
    aliases = s.where("row % 9 = 0").selectExpr("actor", "title alias", "row % 50 entity")
    editions = s.where("edition is not null and row % 10 = 0").selectExpr("edition", "row % 70 entity")
    groups = s.where("edition is not null").selectExpr("edition", "'g' || row % 250 grp")
    out = S.resolve_child(s, d, aliases, editions, groups)
    return out.select("row", "how", F.when(F.col("how") != "new", F.col("entity")).alias("known"))


@query(f"""WITH s AS ({_SEEN}), d AS ({_DIM}), m AS (SELECT max(entity) AS top FROM d), o AS (SELECT DISTINCT {_KEY} AS k FROM s WHERE {_KEY} NOT IN (SELECT {_KEY} FROM d)) SELECT count(*) AS n, min(top) + 1 AS lo, min(top) + count(*) AS hi FROM o, m""")
def e2_new_entities(t):
    """Without other rules, each unknown title of an actor is one new work, numbered after the known ones."""
    s, d = from_sql(t, _SEEN), from_sql(t, _DIM)
    out = S.resolve_by(s, [("title", d.select(S.title_key("actor", "title").alias("k"), "entity"), S.title_key("actor", "title"))], S.title_key("actor", "title"), d)
    return out.where("how = 'new'").agg(F.countDistinct("entity").alias("n"), F.min("entity").alias("lo"), F.max("entity").alias("hi"))


@query(f"""WITH s AS ({_SEEN}), d AS ({_DIM}), a AS (SELECT actor || ':' || lower(trim(title)) AS k, min(row % 50) AS e FROM s WHERE row % 9 = 0 GROUP BY 1), i AS (SELECT grp AS k, min(entity) AS e FROM d WHERE grp IS NOT NULL GROUP BY 1), sl AS (SELECT edition AS k, min(row % 70) AS e FROM s WHERE edition IS NOT NULL AND row % 10 = 0 GROUP BY 1), n AS (SELECT {_KEY} AS k, min(entity) AS e FROM d GROUP BY 1)
SELECT row, CASE WHEN a.e IS NOT NULL THEN 'alias' WHEN i.e IS NOT NULL THEN 'id' WHEN sl.e IS NOT NULL THEN 'slot' WHEN n.e IS NOT NULL THEN 'title' ELSE 'new' END AS how, coalesce(a.e, i.e, sl.e, n.e) AS known FROM s LEFT JOIN a ON a.k = actor || ':' || lower(trim(title)) LEFT JOIN i ON i.k = grp LEFT JOIN sl ON sl.k = edition LEFT JOIN n ON n.k = {_KEY}""")
def e3_resolve_item(t):
    s, d = from_sql(t, _SEEN), from_sql(t, _DIM)
    aliases = s.where("row % 9 = 0").selectExpr("'alias' kind", "actor || ':' || lower(trim(title)) k", "row % 50 entity").union(s.where("edition is not null and row % 10 = 0").selectExpr("'slot'", "edition", "row % 70"))
    out = S.resolve_item(s.withColumnRenamed("grp", "item_id").withColumnRenamed("edition", "slot_id"), d.withColumnRenamed("grp", "item_id"), aliases)
    return out.select("row", "how", F.when(F.col("how") != "new", F.col("entity")).alias("known"))


@query("SELECT l_partkey AS item, arg_min(l_suppkey, (l_shipdate, l_suppkey)) AS parent FROM lineitem GROUP BY 1")
def e3_first_parent(t):
    return S.first_parent(t("lineitem").select(F.col("l_partkey").alias("item"), F.col("l_suppkey").alias("parent"), "l_shipdate"), "item", "parent", "l_shipdate")


@query("""WITH s AS (SELECT c_custkey AS row, CASE WHEN c_custkey % 3 = 0 THEN 'p' || c_custkey % 90 END AS ext, replace(lower(c_name), 'customer', 'supplier') AS name, c_nationkey::VARCHAR AS city FROM customer), d AS (SELECT s_suppkey AS entity, CASE WHEN s_suppkey % 2 = 0 THEN 'p' || s_suppkey END AS ext, s_name AS name, s_nationkey::VARCHAR AS city FROM supplier)
SELECT row, CASE WHEN i.e IS NOT NULL THEN 'id' WHEN n.e IS NOT NULL THEN 'name' ELSE 'new' END AS how, coalesce(i.e, n.e) AS known FROM s LEFT JOIN (SELECT ext, min(entity) AS e FROM d GROUP BY 1) i ON i.ext = s.ext LEFT JOIN (SELECT lower(name) || '|' || city AS k, min(entity) AS e FROM d GROUP BY 1) n ON n.k = lower(s.name) || '|' || s.city""")
def e5_resolve_places(t):
    s = t("customer").selectExpr("c_custkey row", "case when c_custkey % 3 = 0 then 'p' || c_custkey % 90 end ext", "replace(lower(c_name), 'customer', 'supplier') name", "cast(c_nationkey as string) city")
    d = t("supplier").selectExpr("s_suppkey entity", "case when s_suppkey % 2 = 0 then 'p' || s_suppkey end ext", "s_name name", "cast(s_nationkey as string) city")
    return S.resolve_places(s, d).select("row", "how", F.when(F.col("how") != "new", F.col("entity")).alias("known"))


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, l_suppkey AS performer, 'Song ' || l_partkey % 20 AS title, l_partkey AS item FROM lineitem), a AS (SELECT performer, lower(title) AS t, min(item) AS i FROM l WHERE item % 6 = 0 GROUP BY 1, 2)
SELECT l_orderkey, l_linenumber, coalesce(i, item) AS item, coalesce(i <> item, false) AS relinked FROM l LEFT JOIN a ON a.performer = l.performer AND a.t = lower(title)""")
def e6_relink_covers(t):
    lines = t("lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("performer"), F.concat(F.lit("Song "), (F.col("l_partkey") % 20).cast("string")).alias("title"), F.col("l_partkey").alias("item"))
    return S.relink_covers(lines, lines.where("item % 6 = 0").withColumn("title", F.upper("title"))).select("l_orderkey", "l_linenumber", "item", "relinked")


@query("""WITH r AS (SELECT o_orderkey, o_custkey % 30 AS actor, o_orderkey % 200 AS grp FROM orders), c AS (SELECT DISTINCT l_orderkey % 150 AS grp, 'x' || l_suppkey % 40 AS ext FROM lineitem WHERE l_linenumber < 3), i AS (SELECT s_suppkey % 30 AS actor, 'x' || s_suppkey % 40 AS ext FROM supplier WHERE s_suppkey % 2 = 0)
SELECT o_orderkey, EXISTS (SELECT 1 FROM c WHERE c.grp = r.grp) AND NOT EXISTS (SELECT 1 FROM c WHERE c.grp = r.grp AND (ext = 'x7' OR ext IN (SELECT ext FROM i WHERE i.actor = r.actor))) AS mismatch FROM r""")
def e7_credit_guard(t):
    resolved = t("orders").selectExpr("o_orderkey", "o_custkey % 30 actor", "o_orderkey % 200 grp")
    credits = t("lineitem").where("l_linenumber < 3").selectExpr("l_orderkey % 150 grp", "'x' || l_suppkey % 40 ext")
    ids = t("supplier").where("s_suppkey % 2 = 0").selectExpr("s_suppkey % 30 actor", "'x' || s_suppkey % 40 ext").groupBy("actor").agg(F.collect_set("ext").alias("ids"))
    return S.credit_guard(resolved, credits, ids, ["x7"]).select("o_orderkey", "mismatch")


_PARENTS = "SELECT p_partkey AS entity, CASE WHEN p_partkey % 5 = 0 THEN 'g' || p_partkey % 100 ELSE 'e' || p_partkey % 400 END AS ext FROM part"
_CACHE = "SELECT s_suppkey AS i, 'e' || s_suppkey AS ext, CASE WHEN s_suppkey % 3 > 0 THEN 'g' || s_suppkey % 30 END AS grp FROM supplier"


@query(f"""WITH p AS ({_PARENTS}), c AS ({_CACHE}), m AS (SELECT entity, p.ext IN (SELECT grp FROM c WHERE grp IS NOT NULL) AS is_g, c.ext IS NOT NULL AS looked, CASE WHEN p.ext IN (SELECT grp FROM c WHERE grp IS NOT NULL) THEN p.ext ELSE c.grp END AS grp FROM p LEFT JOIN c ON c.ext = p.ext)
SELECT entity, CASE WHEN is_g THEN 'done' WHEN NOT looked THEN 'lookup' WHEN grp IS NULL THEN 'invalid' WHEN count(*) OVER (PARTITION BY grp) > 1 THEN 'duplicate' ELSE 'convert' END AS status, grp FROM m""")
def e12_edition_report(t):
    return S.edition_report(from_sql(t, _PARENTS), from_sql(t, _CACHE))


@query("""WITH i AS (SELECT p_partkey AS item, p_name || p_size % 5 AS k FROM part), m AS (SELECT i.*, item IN (SELECT l_partkey FROM lineitem WHERE l_partkey % 5 < 3 AND l_linenumber = 1) AS f, item IN (SELECT l_partkey FROM lineitem WHERE l_partkey % 7 < 4 AND l_linenumber = 2) AS l FROM i)
SELECT k, min(item) FILTER (f AND NOT l) AS played, min(item) FILTER (l AND NOT f) AS seen FROM m GROUP BY 1 HAVING played IS NOT NULL AND seen IS NOT NULL""")
def d8_split_rows(t):
    items = t("part").select(F.col("p_partkey").alias("item"), F.concat("p_name", (F.col("p_size") % 5).cast("string")).alias("k"))
    facts, lines = (t("lineitem").where(c).select(F.col("l_partkey").alias("item")) for c in ("l_partkey % 5 < 3 and l_linenumber = 1", "l_partkey % 7 < 4 and l_linenumber = 2"))
    return S.split_rows(items, facts, lines, "item", "k")


@query("""WITH i AS (SELECT p_partkey AS item, p_size AS parent, p_name AS k FROM part), f AS (SELECT l_partkey AS item, count(*) AS p FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), m AS (SELECT i.*, coalesce(p, 0) AS p FROM i LEFT JOIN f USING (item))
SELECT parent, k, count(*) AS n, sum(p)::BIGINT AS plays, (SELECT count(DISTINCT l_orderkey) FROM lineitem JOIN i ON i.item = l_partkey WHERE i.parent = m.parent AND i.k = m.k AND l_returnflag = 'A') AS shows, arg_min(item, (-p, item)) AS item FROM m GROUP BY parent, k""")
def d14_group_items(t):
    items = t("part").select(F.col("p_partkey").alias("item"), F.col("p_size").alias("parent"), F.col("p_name").alias("k"))
    lines = t("lineitem")
    return S.group_items(items, lines.where("l_returnflag = 'R'").select(F.col("l_partkey").alias("item")), lines.where("l_returnflag = 'A'").select(F.col("l_partkey").alias("item"), F.col("l_orderkey").alias("event")), "item", "parent", "k")


@query("""SELECT p_partkey AS absorbed, p_partkey - 1 AS canonical, 'live' AS tags FROM part WHERE p_partkey % 4 = 0 AND (p_partkey - 1) % 7 <> 0 AND p_partkey - 1 IN (SELECT p_partkey FROM part)
UNION ALL SELECT p_partkey, p_partkey - 1, 'demo,remix' FROM part WHERE p_partkey % 4 = 2 AND p_partkey - 1 IN (SELECT p_partkey FROM part)""")
def d15_variant_merges(t):
    p = t("part")
    journal = p.where("p_partkey % 2 = 0").selectExpr("p_partkey absorbed", "p_partkey - 1 canonical", "p_name || case when p_partkey % 4 = 0 then ' (Live)' else ' (Remix) - Demo [2009 Remaster]' end absorbed_title")
    out = S.variant_merges(journal, p.selectExpr("p_partkey item", "p_name || case when p_partkey % 7 = 0 then ' - Live in Bonn' else '' end title"))
    return out.select("absorbed", "canonical", F.array_join(F.array_sort("tags"), ",").alias("tags"))


@query("""WITH g AS (SELECT DISTINCT 'g' || s_nationkey AS grp, n_name AS tag FROM supplier JOIN nation ON n_regionkey = s_nationkey % 5), p AS (SELECT c_custkey AS parent, CASE WHEN c_custkey % 2 = 0 THEN 'g' || c_nationkey ELSE 'e' || c_custkey % 50 END AS ext FROM customer), r AS (SELECT 'e' || s_suppkey AS ext, min('g' || s_nationkey) AS grp FROM supplier GROUP BY 1)
SELECT DISTINCT parent, tag FROM p LEFT JOIN r ON r.ext = p.ext JOIN g ON g.grp = CASE WHEN p.ext IN (SELECT grp FROM g) THEN p.ext ELSE r.grp END""")
def gn5_tags_to_parents(t):
    s = t("supplier")
    groups = s.join(t("nation"), F.col("n_regionkey") == F.col("s_nationkey") % 5).selectExpr("'g' || s_nationkey grp", "n_name tag").distinct()
    parents = t("customer").selectExpr("c_custkey parent", "case when c_custkey % 2 = 0 then 'g' || c_nationkey else 'e' || c_custkey % 50 end ext")
    return S.tags_to_parents(groups, parents, s.selectExpr("'e' || s_suppkey ext", "'g' || s_nationkey grp"))


@query("""SELECT DISTINCT p_size AS parent, CASE t WHEN 'prog rock' THEN 'progressive rock' ELSE t END AS tag FROM (SELECT p_size, unnest([lower(p_name), 'prog rock', lower(p_type)]) AS t FROM part)""")
def gn6_style_tags(t):
    copies = t("part").select("p_size", F.to_json(F.array(F.upper("p_name"), F.lit(" Prog  Rock"), F.col("p_type"), F.lit(""))).alias("styles"))
    return S.style_tags(copies, "p_size", "styles").withColumnRenamed("p_size", "parent")


@query("""WITH own AS (SELECT l_orderkey AS parent, l_returnflag AS tag, count(*) AS n FROM lineitem WHERE l_linenumber < 3 AND l_orderkey % 4 = 0 GROUP BY 1, 2), ed AS (SELECT l_orderkey AS parent, l_linestatus AS tag, count(*) AS n FROM lineitem WHERE l_orderkey % 4 IN (1, 0) GROUP BY 1, 2),
a AS (SELECT parent, string_agg(tag, ',' ORDER BY tag) AS t FROM own WHERE n >= 2 GROUP BY 1), b AS (SELECT parent, string_agg(tag, ',' ORDER BY tag) AS t FROM ed WHERE n >= 2 GROUP BY 1), c AS (SELECT parent, string_agg(tag, ',' ORDER BY tag) AS t FROM ed GROUP BY 1)
SELECT o_orderkey AS parent, CASE WHEN a.t IS NOT NULL THEN 'group' WHEN b.t IS NOT NULL THEN 'editions' WHEN c.t IS NOT NULL THEN 'edition' WHEN o_orderkey % 3 = 0 THEN 'pending' ELSE 'none' END AS status, coalesce(a.t, b.t, c.t, '') AS tags FROM orders LEFT JOIN a ON a.parent = o_orderkey LEFT JOIN b ON b.parent = o_orderkey LEFT JOIN c ON c.parent = o_orderkey""")
def gn8_tag_fill_plan(t):
    lines = t("lineitem").withColumnRenamed("l_orderkey", "parent")
    votes = lambda c, tag: lines.where(c).groupBy("parent", F.col(tag).alias("tag")).agg(F.count(F.lit(1)).alias("n"))
    parents = t("orders").withColumnRenamed("o_orderkey", "parent")
    out = S.tag_fill_plan(parents, votes("l_linenumber < 3 and parent % 4 = 0", "l_returnflag"), votes("parent % 4 in (1, 0)", "l_linestatus"), parents.where("parent % 3 = 0"))
    return out.select("parent", "status", F.array_join("tags", ",").alias("tags"))


@query(f"""WITH s AS (SELECT p_partkey, p_size AS actor, p_name AS title, 'x' || p_partkey % 700 AS ext FROM part WHERE p_partkey % 2 = 1), l AS (SELECT p_partkey AS entity, p_size AS actor, p_name AS title, CASE WHEN p_partkey % 6 = 0 THEN 'x' || p_partkey % 500 END AS ext FROM part WHERE p_partkey % 2 = 0),
i AS (SELECT ext, min(entity) AS e FROM l WHERE ext IS NOT NULL GROUP BY 1), n AS (SELECT {_KEY} AS k, min(entity) AS e FROM l GROUP BY 1) SELECT s.ext, coalesce(i.e, n.e) AS entity, CASE WHEN i.e IS NOT NULL THEN 'linked' WHEN n.e IS NOT NULL THEN 'title' ELSE 'missing' END AS how FROM s LEFT JOIN i ON i.ext = s.ext LEFT JOIN n ON n.k = {_KEY}""")
def e22_compare_catalogue(t):
    p = t("part")
    return S.compare_catalogue(p.where("p_partkey % 2 = 0").selectExpr("p_partkey entity", "p_size actor", "p_name title", "case when p_partkey % 6 = 0 then 'x' || p_partkey % 500 end ext"), p.where("p_partkey % 2 = 1").selectExpr("p_size actor", "p_name title", "'x' || p_partkey % 700 ext"))


@query("SELECT l_orderkey, count(*) AS lines, count(*) FILTER (l_returnflag = 'N') AS done, count(*) FILTER (l_returnflag = 'R') AS todo, count(*) FILTER (l_returnflag = 'A') AS unchecked FROM lineitem GROUP BY 1")
def e23_line_progress(t):
    return S.line_progress(t("lineitem").select("l_orderkey", F.col("l_returnflag").alias("status")), "l_orderkey", ["N"], ["R"])


_DECIDED = "SELECT l_orderkey AS k, ['accept', 'merge', 'mine', 'theirs', 'reject'][1 + l_partkey % 5] AS decision, l_suppkey::VARCHAR AS target, l_shipdate AS moment FROM lineitem WHERE l_orderkey % 3 = 0"


@query(f"""WITH d AS ({_DECIDED}), l AS (SELECT k, arg_max({{'d': decision, 't': target}}, (moment, decision, target)) AS x FROM d GROUP BY 1)
SELECT o_orderkey AS k, coalesce(x.d, 'open') AS decision, x.t AS target FROM orders LEFT JOIN l ON k = o_orderkey""")
def e24_apply_decisions(t):
    kinds = F.array(*[F.lit(x) for x in ("accept", "merge", "mine", "theirs", "reject")])
    d = t("lineitem").where("l_orderkey % 3 = 0").select(F.col("l_orderkey").alias("k"), F.get(kinds, (F.col("l_partkey") % 5).cast("int")).alias("decision"), F.col("l_suppkey").cast("string").alias("target"), F.col("l_shipdate").alias("at"))
    return S.apply_decisions(t("orders").select(F.col("o_orderkey").alias("k")), d, "k")[0].select("k", "decision", "target")


@query(f"""WITH d AS ({_DECIDED}), l AS (SELECT k, arg_max({{'d': decision, 't': target}}, (moment, decision, target)) AS x FROM d GROUP BY 1)
SELECT k, CASE WHEN x.d IN ('accept', 'theirs') THEN 'take' WHEN x.d = 'merge' THEN 'merge' ELSE 'mark' END AS action, x.t AS target FROM orders JOIN l ON k = o_orderkey WHERE x.d <> 'mine'""")
def e24_decided_changes(t):
    kinds = F.array(*[F.lit(x) for x in ("accept", "merge", "mine", "theirs", "reject")])
    d = t("lineitem").where("l_orderkey % 3 = 0").select(F.col("l_orderkey").alias("k"), F.get(kinds, (F.col("l_partkey") % 5).cast("int")).alias("decision"), F.col("l_suppkey").cast("string").alias("target"), F.col("l_shipdate").alias("at"))
    return S.apply_decisions(t("orders").select(F.col("o_orderkey").alias("k")), d, "k")[1]


_TAGS = "SELECT DISTINCT p_size AS entity, p_type AS tag FROM part"
_TOLD = "SELECT s_suppkey % 50 + 1 AS entity, ['ECONOMY', 'SMALL', 'new tag'][1 + s_suppkey % 3] AS tag, ['keep', 'drop', 'reject'][1 + s_suppkey // 3 % 3] AS decision FROM supplier"


def _told(t):
    pick = lambda words, i: F.get(F.array(*[F.lit(x) for x in words]), i.cast("int"))
    k = F.col("s_suppkey")
    return t("supplier").select((k % 50 + 1).alias("entity"), pick(("ECONOMY", "SMALL", "new tag"), k % 3).alias("tag"), pick(("keep", "drop", "reject"), F.floor(k / 3) % 3).alias("decision"))


_LAST = f"t AS ({_TAGS}), d AS (SELECT entity, tag, max(CASE decision WHEN 'keep' THEN 1 WHEN 'drop' THEN 2 ELSE 3 END) AS d FROM ({_TOLD}) GROUP BY 1, 2)"


@query(f"WITH {_LAST} SELECT * FROM (SELECT * FROM t UNION SELECT entity, tag FROM d WHERE d = 1) EXCEPT SELECT entity, tag FROM d WHERE d > 1")
def gn7_review_tags(t):
    return S.review_tags(t("part").selectExpr("cast(p_size as bigint) entity", "p_type tag"), _told(t), _told(t).select("entity", "tag").limit(0))[0]


@query(f"WITH {_LAST} SELECT entity, tag, 'removed' AS action FROM t JOIN d USING (entity, tag) WHERE d > 1 UNION ALL SELECT entity, tag, 'added' FROM d WHERE d = 1 AND NOT EXISTS (SELECT 1 FROM t WHERE t.entity = d.entity AND t.tag = d.tag)")
def gn7_review_journal(t):
    return S.review_tags(t("part").selectExpr("cast(p_size as bigint) entity", "p_type tag"), _told(t), _told(t).select("entity", "tag").limit(0))[2]


@query("SELECT p_size, lower(p_name) AS k, count(*) AS n, arg_min(p_partkey, (p_partkey % 3 = 0, p_partkey)) AS \"primary\", string_agg(p_partkey, ',' ORDER BY p_partkey) AS members FROM part GROUP BY 1, 2 HAVING count(*) > 1")
def d4_version_groups(t):
    p = t("part").withColumn("title", F.expr("p_name || case when p_partkey % 3 = 0 then ' (Deluxe Edition) - Live' else '' end"))
    return S.version_groups(p, "p_partkey", "p_size", "title", [F.col("p_partkey")]).withColumn("members", F.array_join(F.col("members").cast("array<string>"), ","))


@query("""WITH m AS (SELECT l_orderkey AS k, l_linenumber AS line, l_partkey AS item FROM lineitem WHERE l_returnflag = 'R')
SELECT o_orderkey AS k, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS lines, (SELECT count(DISTINCT line) FROM m WHERE k = o_orderkey) AS matched, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) - (SELECT count(DISTINCT line) FROM m WHERE k = o_orderkey) AS empty,
(SELECT count(DISTINCT l_partkey) FROM lineitem WHERE l_orderkey = o_orderkey) - (SELECT count(DISTINCT item) FROM m WHERE k = o_orderkey) AS extra FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)""")
def d13_list_queue(t):
    lines = t("lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("item"), "l_returnflag")
    return S.list_queue(lines.where("l_returnflag = 'R'"), lines, lines.select("k", "item").distinct(), "k")


@query("SELECT 'x' || (props->>'$.k') AS id, event_id FROM events WHERE (props->>'$.k')::BIGINT % 3 = 0")
def e19_evidence_for(t):
    bronze = t("events").select(F.to_json(F.struct(F.struct(F.concat(F.lit("x"), F.get_json_object("props", "$.k")).alias("id")).alias("thing"))).alias("json"), "event_id")
    ids = t("events").select(F.get_json_object("props", "$.k").cast("long").alias("k")).where("k % 3 = 0").select(F.concat(F.lit("x"), F.col("k").cast("string")).alias("id"))
    return S.evidence_for(bronze, ids, "$.thing.id", ["event_id"])


@query("""WITH l AS (SELECT p_brand AS grp, lower(p_name) AS k, min(p_size) AS d, min(CASE WHEN p_type = 'SMALL' THEN 0 ELSE 1 END) AS o FROM part GROUP BY 1, 2), i AS (SELECT min(p_partkey) AS item, lower(p_name) AS k FROM part GROUP BY 2)
SELECT item, grp, d AS date, row_number() OVER (PARTITION BY item ORDER BY o, d, grp) AS nth FROM i JOIN l USING (k)""")
def e21_groups_of_item(t):
    p = t("part")
    listed = p.select(F.col("p_brand").alias("grp"), F.upper("p_name").alias("title"), F.when(F.col("p_type") == "SMALL", "studio").otherwise("other").alias("kind"), F.col("p_size").alias("date"))
    return S.groups_of_item(listed, p.groupBy(F.col("p_name").alias("title")).agg(F.min("p_partkey").alias("item")))


@query("""WITH i AS (SELECT p_partkey AS item, 'i' || p_partkey % 150 AS ext FROM part), k AS (SELECT 'i' || s_suppkey AS ext, CASE WHEN s_suppkey % 3 = 0 THEN 'item' WHEN s_suppkey % 3 = 1 THEN 'slot' ELSE 'none' END AS kind, CASE WHEN s_suppkey % 3 = 1 THEN 't' || s_suppkey END AS target FROM supplier), m AS (SELECT item, k.ext IS NOT NULL AS seen, kind, CASE WHEN kind = 'item' THEN i.ext ELSE target END AS target FROM i LEFT JOIN k ON k.ext = i.ext)
SELECT item, CASE WHEN NOT seen THEN 'pending' WHEN target IS NULL THEN 'invalid' WHEN count(*) OVER (PARTITION BY target) > 1 THEN 'duplicate' WHEN kind = 'item' THEN 'confirmed' ELSE 'convert' END AS status, target FROM m""")
def e13_item_id_report(t):
    items = t("part").selectExpr("p_partkey item", "'i' || p_partkey % 150 ext")
    known = t("supplier").selectExpr("'i' || s_suppkey ext", "case s_suppkey % 3 when 0 then 'item' when 1 then 'slot' else 'none' end kind", "case when s_suppkey % 3 = 1 then 't' || s_suppkey end target")
    return S.item_id_report(items, known)


@query("""SELECT c_custkey AS copy, s_suppkey AS edition, CASE WHEN s_suppkey % 7 = 0 THEN 'set' WHEN c_custkey % 4 = 0 OR c_custkey % 3 = s_suppkey % 3 THEN 'same' ELSE 'differs' END AS relation FROM customer JOIN supplier ON c_nationkey * 10 + c_custkey % 10 = s_nationkey * 10 + s_suppkey % 10""")
def e18_suggest_links(t):
    copies = t("customer").selectExpr("c_custkey copy", "c_nationkey * 10 + c_custkey % 10 code", "case when c_custkey % 4 > 0 then c_custkey % 3 end year")
    editions = t("supplier").selectExpr("s_suppkey edition", "s_nationkey * 10 + s_suppkey % 10 code", "s_suppkey % 3 year", "case when s_suppkey % 7 = 0 then 'a set' end part_of")
    return S.suggest_links(copies, editions)


@query("""SELECT * FROM (SELECT c_custkey, array_to_string(list_filter([CASE WHEN n IS NULL THEN 'not found' END, CASE WHEN c_acctbal < 0 THEN 'low' END, CASE WHEN n >= 2 AND urgent = 0 THEN 'none of several' END], lambda x: x IS NOT NULL), ',') AS flags
FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent FROM orders GROUP BY 1) ON o_custkey = c_custkey) WHERE flags <> ''""")
def q4_verify_actors(t):
    """Customers as actors, their orders as the titles looked up, urgent ones as those found."""
    n = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("urgent"))
    flags = {"not found": F.col("n").isNull(), "low": F.col("c_acctbal") < 0, "none of several": (F.col("n") >= 2) & (F.col("urgent") == 0)}
    return S.verify_flags(t("customer").join(n, "c_custkey", "left"), flags, "c_custkey").select("c_custkey", F.array_join("flags", ",").alias("flags"))


@query("""SELECT * FROM (SELECT l_orderkey, l_linenumber, array_to_string(list_filter([CASE WHEN p_size > 45 THEN 'year' END, CASE WHEN p_brand IN ('Brand#1', 'Brand#2') AND p_type <> 'SMALL' THEN 'type' END, CASE WHEN p_name LIKE 'red%' THEN 'title' END], lambda x: x IS NOT NULL), ',') AS flags FROM lineitem JOIN part ON p_partkey = l_partkey) WHERE flags <> ''""")
def q5_verify_parents(t):
    flags = {"year": F.col("p_size") > 45, "type": F.col("p_brand").isin("Brand#1", "Brand#2") & (F.col("p_type") != "SMALL"), "title": F.col("p_name").startswith("red")}
    met = t("lineitem").join(t("part"), F.col("p_partkey") == F.col("l_partkey")).withColumn("row", F.struct("l_orderkey", "l_linenumber"))
    return S.verify_flags(met, flags, "row").select("row.l_orderkey", "row.l_linenumber", F.array_join("flags", ",").alias("flags"))


@query("""WITH c AS (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'none' WHEN p_size > 20 THEN 'ok' ELSE 'bad' END AS year, CASE WHEN p_name LIKE '%ring%' THEN 'ok' ELSE 'bad' END AS title, CASE WHEN p_brand = 'Brand#3' THEN 'none' WHEN p_retailprice > 1000 THEN 'ok' ELSE 'bad' END AS cover FROM part)
SELECT p_partkey, year || ',' || title || ',' || cover AS items, round(100 * ((year = 'ok')::INTEGER + (title = 'ok')::INTEGER + (cover = 'ok')::INTEGER) / ((year <> 'none')::INTEGER + 1 + (cover <> 'none')::INTEGER), 1) AS score FROM c""")
def q6_inventory_checklist(t):
    checks = {"year": (F.col("p_size") % 2 != 0, F.col("p_size") > 20), "title": (F.lit(True), F.col("p_name").contains("ring")), "cover": (F.col("p_brand") != "Brand#3", F.col("p_retailprice") > 1000)}
    return S.checklist(t("part"), checks, "p_partkey").select("p_partkey", F.array_join(F.transform("items", lambda x: x["status"]), ",").alias("items"), "score")


@query(f"""WITH s AS (SELECT p_partkey AS line, p_size AS actor, CASE WHEN p_partkey % 6 = 0 THEN 'Guitar Solo' ELSE p_name END AS title, p_partkey AS item FROM part), pl AS (SELECT p_partkey AS item FROM part WHERE p_partkey % 4 = 0), t AS (SELECT {_KEY} AS k, min(item) AS m FROM (SELECT p_size AS actor, p_name AS title, p_partkey AS item FROM part WHERE p_partkey % 8 = 0) GROUP BY 1),
l AS (SELECT DISTINCT {_KEY} AS k FROM (SELECT p_size AS actor, p_name AS title FROM part WHERE p_partkey % 9 = 0)), c AS (SELECT DISTINCT {_KEY} AS k FROM (SELECT p_size AS actor, p_name AS title FROM part WHERE p_partkey % 5 = 0))
SELECT line, CASE WHEN item IN (SELECT item FROM pl) THEN 'ok' WHEN m IS NOT NULL THEN 'match' WHEN l.k IS NOT NULL THEN 'listed' WHEN title = 'Guitar Solo' THEN 'solo' WHEN c.k IS NOT NULL THEN 'looked up' ELSE 'unchecked' END AS status, CASE WHEN item NOT IN (SELECT item FROM pl) THEN m END AS match
FROM (SELECT *, {_KEY} AS k FROM s) s LEFT JOIN t ON t.k = s.k LEFT JOIN l ON l.k = s.k LEFT JOIN c ON c.k = s.k""")
def e17_line_status(t):
    p = t("part").select(F.col("p_partkey").alias("item"), F.col("p_size").alias("actor"), F.col("p_name").alias("title"))
    lines = p.select(F.col("item").alias("line"), "actor", F.when(F.col("item") % 6 == 0, "Guitar Solo").otherwise(F.col("title")).alias("title"), "item")
    return S.line_status(lines, p.where("item % 4 = 0"), p.where("item % 8 = 0"), p.where("item % 9 = 0"), p.where("item % 5 = 0")).select("line", "status", "match")
