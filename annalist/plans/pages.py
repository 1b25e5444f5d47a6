"""Queries over the pages and the summaries they are made of."""

from __future__ import annotations

from pyspark.sql import functions as F

from annalist.functions import times
from annalist.operators import relational as R
from annalist.operators import summaries as P
from annalist.plans.registry import END, PREVIOUS, START, query
from annalist.plans.titles import _CONDITION, FORMAT


@query("SELECT count(*) AS plays, count(DISTINCT user_id) AS actors, count(DISTINCT event_type) AS items, count(*) FILTER (ts >= TIMESTAMP '2024-01-28' - INTERVAL 20 DAY AND ts < TIMESTAMP '2024-01-28') AS recent, (SELECT count(*) FROM (SELECT min(ts) AS f FROM events GROUP BY event_type) WHERE f >= TIMESTAMP '2024-01-28' - INTERVAL 20 DAY AND f < TIMESTAMP '2024-01-28') AS discovered FROM events")
def p1_overview(t):
    return P.overview(t("events"), "event_type", "user_id", "ts", "2024-01-28", 20)


@query(f"""WITH p AS (SELECT * FROM events WHERE ts >= TIMESTAMP '{START}' AND ts < TIMESTAMP '{END}'), d AS (SELECT unnest(generate_series(DATE '{START}', DATE '{END}' - INTERVAL 1 DAY, INTERVAL 1 DAY))::DATE AS d)
SELECT 'day' AS part, d::VARCHAR AS bucket, (SELECT count(*) FROM p WHERE ts::DATE = d) AS n FROM d UNION ALL SELECT 'hour', hour(ts)::VARCHAR, count(*) FROM p GROUP BY 2 UNION ALL SELECT 'weekday', (isodow(ts) - 1)::VARCHAR, count(*) FROM p GROUP BY 2
UNION ALL SELECT 'figure', 'plays', count(*) FROM p UNION ALL SELECT 'figure', 'items', count(DISTINCT event_type) FROM p UNION ALL SELECT 'figure', 'actors', count(DISTINCT user_id) FROM p UNION ALL SELECT 'figure', 'new', count(*) FROM (SELECT min(ts) AS f FROM events GROUP BY event_type) WHERE f >= TIMESTAMP '{START}' AND f < TIMESTAMP '{END}'""")
def p2_activity_report(t):
    return P.activity_report(t("events"), "event_type", "user_id", "ts", START, END)


@query(f"SELECT event_id, event_type FROM events WHERE ts >= TIMESTAMP '{START}' AND ts < TIMESTAMP '{END}' AND contains(lower(event_type), 'ic') ORDER BY ts DESC, event_id LIMIT 20 OFFSET 20")
def p3_browse_plays(t):
    return P.browse_plays(t("events"), ["event_type"], "IC", "ts", START, END, "event_id", 2, 20).select("event_id", "event_type")


@query(f"""WITH c AS (SELECT user_id, count(*) FILTER (ts >= TIMESTAMP '{START}') AS now, count(*) FILTER (ts < TIMESTAMP '{START}') AS before FROM events WHERE ts >= TIMESTAMP '{PREVIOUS}' AND ts < TIMESTAMP '{END}' GROUP BY 1), n AS (SELECT user_id, now, rank() OVER (ORDER BY now DESC) AS rank_now FROM c WHERE now > 0), e AS (SELECT user_id, count(*) AS ever, min(ts) AS first, max(ts) AS last FROM events WHERE user_id IS NOT NULL GROUP BY 1)
SELECT user_id, now AS plays, rank_now, ever, first, last, r.rank_ever FROM n JOIN (SELECT *, rank() OVER (ORDER BY ever DESC) AS rank_ever FROM e) r USING (user_id)""")
def p4_browse_entities(t):
    return P.browse_entities(t("events").where("user_id is not null"), "user_id", "ts", PREVIOUS, START, END).select("user_id", "plays", "rank_now", "ever", "first", "last", "rank_ever")


@query("""WITH e AS (SELECT * FROM events WHERE user_id IS NOT NULL), a AS (SELECT user_id, count(*) AS n, min(ts) AS first, max(ts) AS last, count(DISTINCT event_type) AS children FROM e GROUP BY 1), b AS (SELECT user_id, event_type, count(*) AS c FROM e GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) = 1)
SELECT user_id, n, first, last, children, rank() OVER (ORDER BY n DESC) AS rank, event_type AS best, c AS best_n, round(n / (SELECT count(*) FROM e), 9) AS share FROM a JOIN b USING (user_id)""")
def p5_entity_pages(t):
    out = P.entity_pages(t("events").where("user_id is not null"), "user_id", "event_type", "ts")
    return out.select("user_id", "n", "first", "last", "children", "rank", "best", "best_n", F.round("share", 9).alias("share"))


@query("""WITH a AS (SELECT l_suppkey, count(*) AS n, min(l_shipdate) AS first, max(l_shipdate) AS last, count(DISTINCT l_partkey) AS children FROM lineitem GROUP BY 1), b AS (SELECT l_suppkey, l_partkey, count(*) AS c FROM lineitem GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY count(*) DESC, l_partkey) = 1)
SELECT l_suppkey, n, first, last, children, rank() OVER (ORDER BY n DESC) AS rank, l_partkey AS best, c AS best_n, round(n / (SELECT count(*) FROM lineitem), 9) AS share FROM a JOIN b USING (l_suppkey)""")
def p6_parent_pages(t):
    out = P.entity_pages(t("lineitem"), "l_suppkey", "l_partkey", "l_shipdate")
    return out.select("l_suppkey", "n", "first", "last", "children", "rank", "best", "best_n", F.round("share", 9).alias("share"))


@query("""WITH f AS (SELECT l_suppkey AS parent, l_partkey % 10 AS item, l_shipdate AS ts, CASE WHEN l_suppkey % 2 = 0 THEN l_orderkey % 5 ELSE l_orderkey % 50 END AS sh FROM lineitem),
s AS (SELECT parent, sh, min(ts) AS w FROM f GROUP BY ALL), k AS (SELECT parent, count(*) AS shows FROM s GROUP BY ALL),
c AS (SELECT f.parent, item, 'show' AS kind, s.w, f.sh::VARCHAR AS name, count(*) AS n FROM f JOIN s ON s.parent = f.parent AND s.sh = f.sh JOIN k ON k.parent = f.parent WHERE shows <= 24 GROUP BY ALL
UNION ALL SELECT f.parent, item, 'year', make_timestamp(year(ts), 1, 1, 0, 0, 0), year(ts)::VARCHAR, count(*) FROM f JOIN k ON k.parent = f.parent WHERE shows > 24 GROUP BY ALL)
SELECT parent, item, kind, string_agg(name || '=' || n, ',' ORDER BY w, name) AS cells FROM c GROUP BY ALL""")
def p6_parent_matrix(t):
    """How often each kind of part stood on each supplier's orders: by order if there are few, else by year."""
    f = t("lineitem").select(F.col("l_suppkey").alias("parent"), (F.col("l_partkey") % 10).alias("item"), F.col("l_shipdate").alias("ts"), F.expr("case when l_suppkey % 2 = 0 then l_orderkey % 5 else l_orderkey % 50 end").alias("show"))
    return P.matrix(f, "parent", "item", "show", "ts").withColumn("cells", F.array_join(F.transform("cells", lambda c: F.concat_ws("=", c["at"], c["n"].cast("string"))), ","))


@query("""WITH p AS (SELECT user_id % 300 AS item, count(*) AS n, min(ts) AS first, max(ts) AS last FROM events WHERE user_id IS NOT NULL GROUP BY 1), h AS (SELECT user_id % 300 AS item, hour(ts) AS h FROM events WHERE user_id IS NOT NULL GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY user_id % 300 ORDER BY count(*) DESC, hour(ts)) = 1), m AS (SELECT p_partkey AS item, p_name AS key, coalesce(n, 0) AS n, first, last, h::INTEGER AS hour FROM part LEFT JOIN p ON p.item = p_partkey LEFT JOIN h ON h.item = p_partkey)
SELECT *, count(*) OVER (PARTITION BY key) AS versions, sum(n) OVER (PARTITION BY key)::BIGINT AS all_plays FROM m""")
def p7_item_pages(t):
    plays = t("events").where("user_id is not null").withColumn("item", F.col("user_id") % 300)
    return P.item_pages(plays, t("part").select(F.col("p_partkey").alias("item"), F.col("p_name").alias("key")), "item", "key", "ts")


@query("""WITH e AS (SELECT o_custkey % 20 AS place, o_custkey AS actor, o_orderdate::DATE AS d FROM orders), r AS (SELECT place, d, d - row_number() OVER (PARTITION BY place ORDER BY d)::INTEGER AS g FROM (SELECT DISTINCT place, d FROM e)), l AS (SELECT place, max(n) AS longest_run FROM (SELECT place, g, count(*) AS n FROM r GROUP BY 1, 2) GROUP BY 1)
SELECT place, count(*) AS n, min(d) AS first, max(d) AS last, count(DISTINCT actor) AS actors, longest_run FROM e JOIN l USING (place) GROUP BY place, longest_run""")
def p9_event_hub(t):
    e = t("orders").select((F.col("o_custkey") % 20).alias("place"), F.col("o_custkey").alias("actor"), F.col("o_orderdate").cast("date").alias("d"))
    return P.event_hub(e, "place", "actor", "d")


@query("""WITH s AS (SELECT o_custkey % 500 AS actor, o_orderdate::DATE AS d FROM orders WHERE o_orderpriority = '1-URGENT'), f AS (SELECT o_custkey % 500 AS actor, o_orderdate::DATE AS d FROM orders), a AS (SELECT actor, count(*) AS n, min(d) AS first, max(d) AS last FROM s GROUP BY 1)
SELECT actor, n, first, last, (SELECT count(*) FROM f WHERE f.actor = a.actor AND d < first) AS before, (SELECT count(*) FROM f WHERE f.actor = a.actor AND d >= first) AS since FROM a""")
def p10_event_insights(t):
    o = t("orders").select((F.col("o_custkey") % 500).alias("actor"), F.col("o_orderdate").alias("d"), "o_orderpriority")
    return P.event_insights(o.where("o_orderpriority = '1-URGENT'"), o, "actor", "d", "d")


@query("""SELECT o_orderkey, o_custkey, row_number() OVER a AS nth, count(*) OVER (PARTITION BY o_custkey) AS "of", lag(o_orderkey) OVER a AS previous, lead(o_orderkey) OVER a AS next, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey) AS nth_there FROM orders WINDOW a AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def p11_event_pages(t):
    return P.event_pages(t("orders"), "o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate").select("o_orderkey", "o_custkey", "nth", "of", "previous", "next", "nth_there")


@query("SELECT 'orders' AS step, c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT 'urgent', c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def p14_evidence_todo(t):
    o = t("orders").withColumnRenamed("o_custkey", "c_custkey")
    return P.evidence_todo(t("customer"), {"orders": o, "urgent": o.where("o_orderpriority = '1-URGENT'")}, "c_custkey")


@query("SELECT o_orderkey, (SELECT count(*) FROM orders f WHERE f.o_custkey = o.o_custkey AND f.o_orderpriority = '1-URGENT' AND f.o_orderdate::DATE <= o.o_orderdate::DATE) AS facts_until FROM orders o")
def j3_with_stats_as_of(t):
    o = t("orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    return P.with_stats(o, o.where("o_orderpriority = '1-URGENT'"), "o_custkey", "o_orderdate", "o_orderdate").select("o_orderkey", "facts_until")


@query("SELECT p_brand, count(*) AS n, count(DISTINCT p_name) AS n_p_name, count(DISTINCT p_type) AS n_p_type FROM part GROUP BY 1")
def ag3_distinct_counts_by(t):
    return P.distinct_counts(t("part"), ["p_brand"], ["p_name", "p_type"])


@query("SELECT p_brand, lower(p_name) AS title, count(*) AS n FROM part GROUP BY 1, 2 HAVING count(*) >= 2")
def ag7_having_twins(t):
    return P.having(t("part").withColumn("title", F.lower("p_name")), ["p_brand", "title"], {"n": P.rows()}, "n >= 2")


@query("SELECT p_brand, array_to_string(list(p_name ORDER BY c DESC, p_name)[1:4], '|') AS spellings FROM (SELECT p_brand, p_name, count(*) AS c FROM part GROUP BY 1, 2) GROUP BY 1")
def ag9_top_spellings(t):
    return P.spellings(t("part"), "p_brand", "p_name").select("p_brand", F.array_join("spellings", "|").alias("spellings"))


@query("SELECT p_brand, string_agg(DISTINCT p_type, ', ' ORDER BY p_type) AS \"values\" FROM part GROUP BY 1")
def ag11_joined_values(t):
    return P.join_values(t("part"), "p_brand", "p_type")


@query("SELECT o_orderpriority AS value, count(*) AS n, CASE o_orderpriority WHEN '5-LOW' THEN 0 WHEN '1-URGENT' THEN 1 ELSE 2 END AS place FROM orders GROUP BY 1")
def ag13_tally_in_order(t):
    return P.tally(t("orders"), F.col("o_orderpriority"), ["5-LOW", "1-URGENT"])


@query("SELECT p_type, round(ln(1 + (SELECT count(DISTINCT p_name) FROM part) / count(DISTINCT p_name)), 8) AS weight FROM part GROUP BY 1")
def s35_weights_of_tags(t):
    return P.tag_weights(t("part"), "p_name", "p_type").select("p_type", F.round("weight", 8).alias("weight"))


@query("SELECT p_brand, p_retailprice, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS r FROM part) WHERE r = 1 ORDER BY p_retailprice DESC, p_partkey LIMIT 8")
def t4_diverse_first(t):
    return P.diverse_top(t("part"), "p_brand", "p_retailprice", "p_partkey", 8)


@query("SELECT p_brand, count(*) FILTER (p_size > 20) AS known, count(*) FILTER (p_size <= 20 AND p_size > 5) AS pending, count(*) AS n, round(100 * count(*) FILTER (p_size > 20) / count(*), 1) AS percent FROM part GROUP BY 1")
def ag17_coverage_by(t):
    return P.coverage(t("part"), "p_brand", F.col("p_size") > 20, F.col("p_size") > 5)


_RECORD = {"kind": "CASE WHEN p_partkey % 5 = 0 THEN 'original' END", "pressed": "1970 + p_size", "album": "1970 + p_size - p_partkey % 4 + 1"}


@query(f"""WITH a AS (SELECT p_partkey, {FORMAT} AS f, {_CONDITION} AS c, {', '.join(f'{v} AS {k}' for k, v in _RECORD.items())} FROM part), b AS (SELECT *, CASE WHEN kind IS NOT NULL THEN false ELSE regexp_matches(f, '(^|[+,])\\s*(RE|RP|RM)\\s*($|[+,])') END AS m FROM a), d AS (SELECT *, CASE WHEN m AND album >= pressed THEN NULL ELSE album END AS year FROM b)
SELECT p_partkey, m OR (kind IS NULL AND coalesce(pressed >= year + 2, false)) AS reissue, year, (year // 10 * 10)::VARCHAR || 's' AS decade FROM d""")
def p8_inventory_records(t):
    copies = t("part").select("p_partkey", F.expr(FORMAT).alias("f"), F.expr(_CONDITION).alias("c"), *[F.expr(v).alias(k) for k, v in _RECORD.items()])
    return P.inventory_records(copies, "p_partkey", "f", "c", "kind", "pressed", "album").select("p_partkey", "reissue", "year", "decade")


@query(f"""WITH p AS (SELECT event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '{START}' AND ts < TIMESTAMP '{END}' GROUP BY 1) SELECT event_type, n, round(n / (SELECT sum(n) FROM p), 9) AS share FROM p ORDER BY n DESC, event_type LIMIT 3""")
def ag1_top_in_period(t):
    out = R.most_played(times.in_period(t("events"), "ts", START, END), "event_type", 3)
    return out.select("event_type", F.col(out.columns[1]).alias("n"), F.round("share", 9).alias("share"))


@query(f"""WITH e AS (SELECT * FROM events WHERE user_id IS NOT NULL), n AS (SELECT user_id, event_type, count(*) AS n FROM e WHERE ts >= TIMESTAMP '{START}' AND ts < TIMESTAMP '{END}' GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) = 1), a AS (SELECT user_id, event_type, count(*) AS n FROM e GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) = 1)
SELECT user_id, event_type AS child, n, false AS ever FROM n UNION ALL SELECT user_id, event_type, n, true FROM a WHERE user_id NOT IN (SELECT user_id FROM n)""")
def ag2_best_with_fallback(t):
    return P.best_child_in(t("events").where("user_id is not null"), "user_id", "event_type", "ts", START, END)


@query("""WITH n AS (SELECT o_custkey % 100 AS k, year(o_orderdate)::INTEGER AS year, count(*) AS n FROM orders GROUP BY 1, 2), r AS (SELECT *, rank() OVER (PARTITION BY year ORDER BY n DESC) AS rank FROM n), s AS (SELECT k, unnest(generate_series(min(year), (SELECT max(year) FROM n)))::INTEGER AS year FROM n GROUP BY 1)
SELECT s.k, s.year, coalesce(n, 0) AS n, CASE WHEN rank <= 1 THEN 1 WHEN rank <= 3 THEN 3 WHEN rank <= 10 THEN 10 END AS band FROM s LEFT JOIN r ON r.k = s.k AND r.year = s.year""")
def w11_rank_bands(t):
    return P.rank_bands(t("orders").select((F.col("o_custkey") % 100).alias("k"), "o_orderdate"), "k", "o_orderdate")


@query("""SELECT w AS period, n, true AS users_near, true AS kinds_near FROM (SELECT (date_diff('day', DATE '2024-01-01', ts::DATE) // 7)::INTEGER AS w, count(*) AS n FROM events GROUP BY 1)""")
def ag3_period_sketches(t):
    """Distinct users and kinds of events by week from daily sketches, and whether they are within 3 % of the exact numbers."""
    e = t("events")
    week = F.floor(F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")) / 7).cast("int")
    periods = e.select(week.alias("period")).distinct().select("period", F.expr("date_add(date '2024-01-01', period * 7)").alias("start"), F.expr("date_add(date '2024-01-01', period * 7 + 7)").alias("end"))
    got = P.period_counts(P.daily_sketches(e, "ts", ["user_id", "event_type"]), periods, ["user_id", "event_type"])
    exact = e.groupBy(week.alias("period")).agg(F.countDistinct("user_id").alias("u"), F.countDistinct("event_type").alias("k"))
    near = lambda a, b: F.abs(F.col(a) - F.col(b)) <= 0.03 * F.col(b)
    return got.join(exact, "period").select("period", "n", near("n_user_id", "u").alias("users_near"), near("n_event_type", "k").alias("kinds_near"))
