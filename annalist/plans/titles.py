"""Queries over the functions of titles and inventory texts. Titles and formats are made of columns of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from annalist.functions import inventory as V
from annalist.functions import text, titles
from annalist.plans.registry import query

#: A title with suffixes, of part; SQL for both sides.
TITLE = """CASE p_partkey % 14 WHEN 0 THEN p_name WHEN 1 THEN p_name || ' (Live at ' || p_brand || ')' WHEN 2 THEN p_name || ' - 2011 Remaster' WHEN 3 THEN p_name || ' [Deluxe Edition]'
 WHEN 4 THEN p_name || ' (Demo) (2009 Remastered)' WHEN 5 THEN p_name || ' - English Version' WHEN 6 THEN p_name || ' - Radio Edit' WHEN 7 THEN p_name || ' II' WHEN 8 THEN p_name || ' (Original Mix)'
 WHEN 9 THEN p_name || ' - Part 4' WHEN 10 THEN p_name || ' (Club Remix) - Live' WHEN 11 THEN 'Björk''s ' || p_name || ' & the Łódź Ærø' WHEN 12 THEN p_name || ' - Single Version' ELSE p_name || ' (' || p_type || ')' END"""



def _tags(s: str) -> str:
    """suffix_tags() in SQL."""
    low = f"lower({s})"
    named = []
    for tag, words in titles.VARIANTS.items():
        but = {"remix": f" AND NOT (regexp_matches({low}, '{titles.ISSUE_MIX}') AND NOT regexp_matches({low}, '{titles.NEW_MIX}'))", "version": f" AND NOT regexp_matches({low}, '{titles.EDITION}')"}.get(tag, "")
        named.append(f"CASE WHEN regexp_matches({low}, '\\b({words})\\b'){but} THEN '{tag}' END")
    every = f"list_filter([{', '.join(named)}, CASE WHEN regexp_matches({low}, '{titles.EDITION}') THEN 'edition' END], lambda x: x IS NOT NULL)"
    language = rf"regexp_extract({low}, '^\s*({'|'.join(titles.LANGUAGES)})(\s+(version|language|lyrics?|vocals?|edition))?\s*$', 1)"
    return f"(CASE WHEN {language} <> '' THEN ['lang-' || {language}] WHEN len({every}) > 0 THEN {every} END)"


_BRACKET, _DASH = r"(?s)^(.+?)\s*[(\[]([^()\[\]]*)[)\]]\s*$", r"(?s)^(.+) - (.*)$"
_SPLIT = f"""WITH RECURSIVE r AS (SELECT p_partkey, trim({TITLE}) AS base, []::VARCHAR[] AS tags, 0 AS n FROM part
UNION ALL SELECT p_partkey, rtrim(CASE WHEN b IS NOT NULL THEN regexp_extract(base, '{_BRACKET}', 1) ELSE regexp_extract(base, '{_DASH}', 1) END), list_concat(tags, coalesce(b, d)), n + 1
FROM (SELECT *, CASE WHEN regexp_matches(base, '{_BRACKET}') THEN {_tags(f"regexp_extract(base, '{_BRACKET}', 2)")} END AS b, CASE WHEN regexp_matches(base, '{_DASH}') THEN {_tags(f"regexp_extract(base, '{_DASH}', 2)")} END AS d FROM r) WHERE b IS NOT NULL OR d IS NOT NULL),
s AS (SELECT p_partkey, arg_max(base, n) AS base, list_sort(list_distinct(arg_max(tags, n))) AS tags FROM r GROUP BY 1)"""


def fold_sql(c: str) -> str:
    return f"trim(regexp_replace(replace(replace(lower(strip_accents({c})), 'ß', 'ss'), '&', ' and '), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'))"


_KEY = fold_sql("base")
_TRACK = fold_sql("regexp_replace(base, '[''’`´]', '', 'g')")


def keyed(t):
    return titles.title_keys(t("part").select("p_partkey", F.expr(TITLE).alias("title")), "title")


@query(f"SELECT doc_id, md5({fold_sql('text')}) AS folded, md5(regexp_replace({fold_sql('text')}, '[ _]+', '', 'g')) AS compact FROM documents")
def s1_fold_texts(t):
    return t("documents").select("doc_id", F.md5(text.fold(F.col("text"))).alias("folded"), F.md5(text.compact(F.col("text"))).alias("compact"))


_NAMED = "CASE s_suppkey % 3 WHEN 0 THEN 'The ' || s_name WHEN 1 THEN s_name || ', The' ELSE s_name END"


@query(f"SELECT s_suppkey, regexp_replace(regexp_replace({fold_sql(_NAMED)}, '^the ', ''), ' the$', '') AS k FROM supplier")
def s2_name_key(t):
    return t("supplier").select("s_suppkey", text.name_key(F.expr(_NAMED)).alias("k"))


@query(f"{_SPLIT} SELECT p_partkey, base, array_to_string(tags, ',') AS tags FROM s")
def s3_split_title(t):
    return keyed(t).select("p_partkey", "base", F.array_join("tags", ",").alias("tags"))


@query(f"{_SPLIT} SELECT p_partkey, {_KEY} AS k FROM s")
def s4_base_key(t):
    return keyed(t).select("p_partkey", F.col("key").alias("k"))


@query(f"{_SPLIT} SELECT p_partkey, {_TRACK} AS k FROM s")
def s5_track_key(t):
    return keyed(t).select("p_partkey", F.col("track_key").alias("k"))


@query(f"{_SPLIT} SELECT p_partkey, array_to_string(list_filter(tags, lambda x: x <> 'edition'), ',') AS tags FROM s")
def s6_variant_tags(t):
    return keyed(t).select("p_partkey", F.array_join("variants", ",").alias("tags"))


@query(f"""{_SPLIT} SELECT p_partkey, CASE WHEN regexp_matches(split_part(k, ' ', -1), '^[0-9]{{1,2}}$') THEN split_part(k, ' ', -1)::INTEGER::VARCHAR
WHEN contains(k, ' ') THEN list_position(['i', 'ii', 'iii', 'iv', 'v', 'vi', 'vii', 'viii', 'ix', 'x'], split_part(k, ' ', -1))::VARCHAR END AS sequel FROM (SELECT p_partkey, {_KEY} AS k FROM s)""")
def s7_sequel_marker(t):
    return keyed(t).select("p_partkey", "sequel")


_WORDS = "list_transform(list_filter(string_split({}, ' '), lambda x: x <> ''), lambda w: CASE WHEN w = 'n' THEN 'and' ELSE coalesce(list_position(['i', 'ii', 'iii', 'iv', 'v', 'vi', 'vii', 'viii', 'ix', 'x'], w)::VARCHAR, w) END)"
_NORDIC = "replace(replace(replace(replace(translate({}, 'øđłð', 'odld'), 'æ', 'ae'), 'œ', 'oe'), 'ß', 'ss'), 'þ', 'th')"


@query(f"""{_SPLIT}, w AS (SELECT p_partkey, {_WORDS.format(_NORDIC.format(_KEY))} AS w FROM s), p AS (SELECT x.p_partkey, x.w AS a, y.w AS b, least(len(x.w), len(y.w)) AS m FROM w x JOIN w y ON y.p_partkey = x.p_partkey + 1),
h AS (SELECT *, len(list_filter(range(1, m + 1), lambda i: a[1:i] = b[1:i])) AS h FROM p), e AS (SELECT *, len(list_filter(range(1, m - h + 1), lambda i: a[len(a) - i + 1:] = b[len(b) - i + 1:])) AS e FROM h)
SELECT p_partkey, array_to_string(a, ' ') AS words, array_to_string(a[h + 1:len(a) - e], ' ') AS mine, array_to_string(b[h + 1:len(b) - e], ' ') AS theirs FROM e""")
def s8_comparison_words(t):
    w = keyed(t).select("p_partkey", titles.comparison_words(F.col("key")).alias("a"))
    met = w.join(w.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("a").alias("b")), "p_partkey")
    d = met.withColumn("d", titles.differing_words(F.col("a"), F.col("b")))
    return d.select("p_partkey", F.array_join("a", " ").alias("words"), F.array_join("d.a", " ").alias("mine"), F.array_join("d.b", " ").alias("theirs"))


_LINE = "CASE p_partkey % 9 WHEN 0 THEN 'Guitar Solo ' || p_name WHEN 1 THEN p_name || ' / ' || p_type WHEN 2 THEN p_name || ' improvisation' WHEN 3 THEN 'Tape Intro' WHEN 4 THEN p_name || ' (Reprise)' WHEN 5 THEN 'Introduction by ' || p_brand WHEN 6 THEN 'Soloist ' || p_name ELSE p_name END"


@query(f"SELECT p_partkey, CASE {' '.join(f'''WHEN regexp_matches(lower({_LINE}), '{p}') THEN '{k}' ''' for k, p in titles.NO_ITEM.items())} END AS kind FROM part")
def s9_no_item_kind(t):
    return t("part").select("p_partkey", titles.no_item_kind(F.expr(_LINE)).alias("kind"))


@query(f"{_SPLIT} SELECT p_partkey, regexp_replace({_TRACK}, '[ _]+', '', 'g') AS k FROM s")
def s10_compact(t):
    return keyed(t).select("p_partkey", F.col("compact").alias("k"))


_PAGE_EDITION = r"\b(remaster(ed)?|live|version|mix|edit|demo|mono|stereo|single|bonus|edition|re-?record(ing)?|session|take|acoustic|instrumental|\d{4})\b"


@query(rf"""WITH a AS (SELECT p_partkey, {TITLE} AS t FROM part),
b AS (SELECT p_partkey, regexp_replace(t, '\s*[(\[].*?[)\]]', '', 'g') AS p, list_concat(regexp_extract_all(t, '[(\[]([^)\]]*)[)\]]', 1), CASE WHEN contains(t, ' - ') THEN [regexp_extract(t, '^.+? - (.*)$', 1)] ELSE [] END) AS tails FROM a),
c AS (SELECT p_partkey, CASE WHEN regexp_matches(lower(regexp_extract(p, '\s+-\s+(.*)$', 1)), '{_PAGE_EDITION}') THEN regexp_replace(p, '\s+-\s+.*$', '') ELSE p END AS p, lower(array_to_string(tails, ' ')) AS tail,
  list_filter(list_transform(tails, lambda x: regexp_extract(lower(trim(x)), '^({'|'.join(titles.LANGUAGES)})(\s+(version|language|lyrics?|vocals?|edition))?$', 1)), lambda x: x <> '') AS lang FROM b)
SELECT p_partkey, regexp_replace({fold_sql("regexp_replace(p, '[''’`´]', '', 'g')")}, '_+', ' ', 'g') || coalesce('#' || CASE WHEN len(lang) > 0 THEN 'lang-' || lang[1] WHEN regexp_matches(tail, '\b(live|unplugged)\b') THEN 'live'
 WHEN regexp_matches(tail, '\b(remix|mix)\b') AND NOT regexp_matches(tail, '\boriginal mix\b') THEN 'remix' WHEN regexp_matches(tail, '\bdemo\b') THEN 'demo' WHEN regexp_matches(tail, '\bacoustic\b') THEN 'acoustic' WHEN regexp_matches(tail, '\binstrumental\b') THEN 'instrumental' END, '') AS k FROM c""")
def s11_page_key(t):
    return t("part").select("p_partkey", titles.page_key(F.expr(TITLE)).alias("k"))


_OTHER = "CASE WHEN p_partkey % 2 = 0 THEN 'the ' || lower(p_type) || ' ' || lower(p_name) ELSE lower(p_brand) || ' ' || lower(p_type) END"


@query(f"""WITH w AS (SELECT p_partkey, list_filter(string_split(lower(p_name), ' '), lambda w: w NOT IN ('', 'the', 'a', 'an')) AS a, list_filter(string_split({_OTHER}, ' '), lambda w: w NOT IN ('', 'the', 'a', 'an')) AS b FROM part),
o AS (SELECT p_partkey, CASE WHEN len(a) <= len(b) THEN a ELSE b END AS s, CASE WHEN len(a) <= len(b) THEN b ELSE a END AS l FROM w)
SELECT p_partkey, len(s) < len(l) AND length(array_to_string(s, '')) >= 5 AND contains(' ' || array_to_string(l, ' ') || ' ', ' ' || array_to_string(s, ' ') || ' ') AS inside FROM o""")
def s12_contains_title(t):
    return t("part").select("p_partkey", titles.contains_title(F.lower("p_name"), F.expr(_OTHER)).alias("inside"))


# --- inventory -------------------------------------------------------------------------------

FORMAT = """CASE p_partkey % 8 WHEN 0 THEN 'LP, Album' WHEN 1 THEN '2xLP, Album, RE, Gat, 180' WHEN 2 THEN '7", Single, Red + CD' WHEN 3 THEN 'LP, Comp, RM, ' || p_type WHEN 4 THEN '3xLP, Box, Ltd, Num, Blu, Blu' WHEN 5 THEN 'Cass, EP' WHEN 6 THEN 'LP, Mar, RP' ELSE p_type END"""
_MEDIA_SQL = "regexp_matches(x, '^(\\d+)?x?(LP|12\"|10\"|7\"|Vinyl|Box Set|CD|Cass)$', 'i')"
_KINDS_SQL = "MAP {" + ", ".join(f"'{c}': '{k}'" for k, of in V.FORMATS.items() for c in of) + "}"
_LABELS_SQL = "MAP {" + ", ".join(f"'{c}': '{label}'" for of in V.FORMATS.values() for c, label in of.items()) + "}"
_FORMAT_SQL = f"""WITH w AS (SELECT p_partkey, p_type, list_filter(list_transform(regexp_split_to_array({FORMAT}, '\\s*\\+\\s*|,'), lambda x: trim(x)), lambda x: x <> '') AS w FROM part),
m AS (SELECT p_partkey, p_type, list_filter(w, lambda x: {_MEDIA_SQL}) AS m, list_filter(w, lambda x: NOT {_MEDIA_SQL}) AS o FROM w),
f AS (SELECT p_partkey, p_type, m, list_filter(o, lambda x, i: list_position(o, x) = i) AS o FROM m)"""


@query(f"""{_FORMAT_SQL} SELECT p_partkey, nullif(array_to_string(m, ' + '), '') AS media, array_to_string(list_transform(o, lambda x: coalesce({_LABELS_SQL}[x], x) || '/' || coalesce({_KINDS_SQL}[x], 'other')), ', ') AS tags,
greatest(1, coalesce(list_sum(list_transform(m, lambda x: coalesce(TRY_CAST(regexp_extract(x, '^(\\d+)x', 1) AS INTEGER), 1))), 0))::INTEGER AS discs, len(list_filter(o, lambda x: x IN ('RE', 'RP', 'RM'))) > 0 AS reissue FROM f""")
def s17_parse_format(t):
    f = t("part").select("p_partkey", V.parse_format(F.expr(FORMAT)).alias("f"))
    return f.select("p_partkey", "f.media", F.array_join(F.transform("f.tags", lambda x: F.concat(x["label"], F.lit("/"), x["kind"])), ", ").alias("tags"), "f.discs", "f.reissue")


@query(r"""SELECT l_orderkey, l_linenumber, (floor(round(ms / 1000) / 60)::BIGINT)::VARCHAR || ':' || lpad((round(ms / 1000)::BIGINT % 60)::VARCHAR, 2, '0') AS length, CASE WHEN round(ms / 60000) < 60 THEN (round(ms / 60000)::BIGINT)::VARCHAR || ' min'
WHEN ms < 36000000 THEN (floor(ms / 3600000)::BIGINT)::VARCHAR || ' h ' || (round((ms / 3600000 - floor(ms / 3600000)) * 60)::BIGINT)::VARCHAR || ' min' ELSE (round(ms / 3600000)::BIGINT)::VARCHAR || ' h' END AS total, l_quantity::BIGINT * 60 + l_linenumber AS seconds
FROM (SELECT *, (l_partkey * 7919 % 50000000)::DOUBLE AS ms FROM lineitem)""")
def s18_durations(t):
    ms = (F.col("l_partkey") * 7919 % 50_000_000).cast("double")
    shown = F.concat(F.col("l_quantity").cast("long").cast("string"), F.lit(":0"), F.col("l_linenumber").cast("string"))
    return t("lineitem").select("l_orderkey", "l_linenumber", V.length_text(ms).alias("length"), V.duration_text(ms).alias("total"), text.seconds(shown).alias("seconds"))


_CONDITION = "CASE p_partkey % 11 WHEN 0 THEN 'Mint (M)' WHEN 1 THEN 'Near Mint (NM or M-)' WHEN 2 THEN 'Very Good Plus (VG+)' WHEN 3 THEN 'Very Good (VG)' WHEN 4 THEN 'Good Plus (G+)' WHEN 5 THEN 'good' WHEN 6 THEN 'Fair' WHEN 7 THEN 'Poor (P)' WHEN 8 THEN 'Not Graded' WHEN 9 THEN p_brand END"


@query(f"""SELECT p_partkey, CASE {' '.join(f"WHEN starts_with(lower(c), '{w}') THEN '{s}'" for w, s, _ in V.GRADES)} WHEN regexp_matches(lower(c), 'generic|no cover|not graded') THEN '-' ELSE c END AS short,
CASE {' '.join(f"WHEN starts_with(lower(c), '{w}') THEN {n}" for w, _, n in V.GRADES)} WHEN c IS NOT NULL THEN 0 END AS score FROM (SELECT p_partkey, {_CONDITION} AS c FROM part)""")
def s19_grades(t):
    return t("part").select("p_partkey", V.grade(F.expr(_CONDITION)).alias("g")).select("p_partkey", "g.short", "g.score")


_COLOUR_LIST = "[" + ", ".join(f"'{c}'" for c in V.COLOURS) + "]"


@query(f"""{_FORMAT_SQL}, c AS (SELECT p_partkey, list_transform(list_filter(o, lambda x: {_KINDS_SQL}[x] = 'colour'), lambda x: lower({_LABELS_SQL}[x])) AS a, list_filter({_COLOUR_LIST}, lambda x: regexp_matches(lower(p_type || ' in sea blue and red' || p_partkey % 3), '\\b' || x || '\\b')) AS b FROM f)
SELECT p_partkey, array_to_string(list_concat(a, list_filter(b, lambda x: NOT list_contains(a, x))), ',') AS colours FROM c""")
def s20_colours(t):
    said = F.concat("p_type", F.lit(" in sea blue and red"), (F.col("p_partkey") % 3).cast("string"))
    return t("part").select("p_partkey", F.array_join(V.colours(V.parse_format(F.expr(FORMAT))["tags"], said), ",").alias("colours"))


@query("SELECT p_partkey, array_to_string(list_filter(list_transform(string_split(p_brand || ' (' || p_partkey % 9 || '), ' || p_brand || ',,' || p_name || ' (12) ', ','), lambda x: trim(regexp_replace(x, '\\s*\\(\\d+\\)', '', 'g'))), lambda x: x <> ''), '|') AS names FROM part")
def s22_credits(t):
    raw = F.expr("p_brand || ' (' || p_partkey % 9 || '), ' || p_brand || ',,' || p_name || ' (12) '")
    return t("part").select("p_partkey", F.array_join(text.credits(raw), "|").alias("names"))


@query("SELECT o_orderkey, year(o_orderdate)::INTEGER AS y, (year(o_orderdate) // 10 * 10)::VARCHAR || 's' AS decade FROM orders")
def s23_years(t):
    y = V.year_of(F.concat(F.lit("released "), F.date_format("o_orderdate", "dd MMM yyyy")))
    return t("orders").select("o_orderkey", y.alias("y"), V.decade(y).alias("decade"))


_PRESSING = "CASE WHEN p_partkey % 5 = 0 THEN 'original' WHEN p_partkey % 7 = 0 THEN 'repress' END AS kind, CASE WHEN p_partkey % 4 > 0 THEN 1970 + p_size END AS pressed, CASE WHEN p_partkey % 6 > 0 THEN 1970 + p_size - p_partkey % 4 + 1 END AS album, p_partkey % 3 = 0 AS marked"


@query(f"""WITH a AS (SELECT p_partkey, {_PRESSING} FROM part), b AS (SELECT *, CASE WHEN kind IS NOT NULL THEN kind <> 'original' ELSE marked END AS m FROM a), c AS (SELECT *, CASE WHEN m AND pressed IS NOT NULL AND album IS NOT NULL AND album >= pressed THEN NULL ELSE album END AS y FROM b)
SELECT p_partkey, y, y IS NULL AND album IS NOT NULL AS unconfirmed, m OR (kind IS NULL AND coalesce(pressed >= y + 2, false)) AS reissue FROM c""")
def s24_pressing_years(t):
    a = t("part").selectExpr("p_partkey", *[x.strip() for x in _PRESSING.replace(" AS kind,", " AS kind;").replace(" AS pressed,", " AS pressed;").replace(" AS album,", " AS album;").split(";")])
    r = a.withColumn("r", V.pressing_years(F.col("kind"), F.col("pressed"), F.col("album"), F.col("marked")))
    return r.select("p_partkey", F.col("r.year").alias("y"), "r.unconfirmed", "r.reissue")


_TAG = "CASE p_partkey % 7 WHEN 0 THEN 'R&B and ' || p_name WHEN 1 THEN 'post-' || p_name || '/ of the uk' WHEN 2 THEN '  Prog   Rock ' WHEN 3 THEN 'NWOBHM' WHEN 4 THEN 'the ' || p_name || ' n roll' ELSE p_type END"
_CAP = "array_to_string(list_transform(regexp_extract_all(w, '[-/]?[^-/]+|[-/]'), lambda p: CASE WHEN regexp_matches(p, '^[-/]') THEN p[1] || upper(p[2]) || p[3:] ELSE upper(p[1]) || p[2:] END), '')"


@query(f"""SELECT p_partkey, array_to_string(list_transform(string_split(t, ' '), lambda w, i: coalesce(MAP {{{', '.join(f"'{a}': '{b}'" for a, b in V.ACRONYMS.items())}}}[lower(w)], CASE WHEN i > 1 AND lower(w) IN ('and', 'of', 'the', 'n', '&') THEN lower(w) END, {_CAP})), ' ') AS shown FROM (SELECT p_partkey, {_TAG} AS t FROM part)""")
def s25_tag_titles(t):
    return t("part").select("p_partkey", V.tag_title(F.expr(_TAG)).alias("shown"))


@query(f"""SELECT p_partkey, coalesce(MAP {{{', '.join(f"'{a}': '{b}'" for a, b in V.SYNONYMS.items())}}}[n], n) AS tag FROM (SELECT p_partkey, trim(regexp_replace(lower({_TAG}), '\\s+', ' ', 'g')) AS n FROM part)""")
def s26_tag_names(t):
    return t("part").select("p_partkey", V.tag_name(F.expr(_TAG)).alias("tag"))


_PRIMARY = "CASE p_partkey % 4 WHEN 0 THEN 'Album' WHEN 1 THEN 'EP' WHEN 2 THEN 'Single' ELSE 'Broadcast' END"
_SECONDARY = {"spark": "CASE p_size % 5 WHEN 0 THEN array('Live') WHEN 1 THEN array('Compilation', 'Live') WHEN 2 THEN array('Remix') WHEN 3 THEN cast(array() as array<string>) END", "duck": "CASE p_size % 5 WHEN 0 THEN ['Live'] WHEN 1 THEN ['Compilation', 'Live'] WHEN 2 THEN ['Remix'] WHEN 3 THEN [] END"}


@query(f"""SELECT p_partkey, CASE WHEN p = 'Single' THEN 'single' WHEN list_contains(s, 'Compilation') THEN 'compilation' WHEN list_contains(s, 'Live') THEN CASE WHEN p IN ('Album', 'EP') THEN 'live' ELSE 'other' END WHEN len(s) > 0 THEN 'other' WHEN p = 'Album' THEN 'album' WHEN p = 'EP' THEN 'ep' ELSE 'other' END AS kind
FROM (SELECT p_partkey, {_PRIMARY} AS p, coalesce({_SECONDARY['duck']}, []) AS s FROM part)""")
def s27_release_kinds(t):
    return t("part").select("p_partkey", V.release_kind(F.expr(_PRIMARY), F.expr(_SECONDARY["spark"])).alias("kind"))


@query(f"""{_SPLIT}, a AS (SELECT p.p_partkey, {TITLE} || CASE WHEN p.p_partkey % 5 = 0 THEN ' Best of' ELSE '' END AS title, s.tags, {_PRIMARY.replace('p_partkey', 'p.p_partkey')} AS p, coalesce({_SECONDARY['duck']}, []) AS s FROM part p JOIN s ON s.p_partkey = p.p_partkey)
SELECT p_partkey, CASE WHEN list_contains(tags, 'remix') AND p = 'Album' AND NOT list_contains(s, 'Remix') THEN 'original' WHEN NOT list_contains(tags, 'remix') AND list_contains(s, 'Remix') THEN 'remix' WHEN list_contains(tags, 'live') AND NOT list_contains(s, 'Live') THEN 'studio'
WHEN NOT list_contains(tags, 'live') AND list_contains(s, 'Live') THEN 'live' WHEN NOT regexp_matches(title, '{V.COMPILATION}') AND list_contains(s, 'Compilation') THEN 'compilation' END AS conflict FROM a""".replace("p_partkey % 14", "p.p_partkey % 14", 2).replace("p.p_partkey % 14", "p_partkey % 14", 1))
def s28_type_conflicts(t):
    k = t("part").select("p_partkey", "p_size", F.expr(TITLE).alias("t")).withColumn("tags", titles.split_title(F.col("t"))["tags"])
    title = F.concat("t", F.expr("CASE WHEN p_partkey % 5 = 0 THEN ' Best of' ELSE '' END"))
    return k.select("p_partkey", V.type_conflict(title, F.col("tags"), F.expr(_PRIMARY), F.expr(_SECONDARY["spark"])).alias("conflict"))


@query(r"""WITH a AS (SELECT page_id, list_filter(list_transform(string_split(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), chr(10)), lambda p: trim(regexp_replace(p, '[ \t]+', ' ', 'g'))), lambda p: p <> '') AS p FROM pages)
SELECT page_id, md5(nullif(array_to_string(p, chr(10) || chr(10)), '')) AS text FROM a""")
def s38_clean_text(t):
    return t("pages").select("page_id", F.md5(V.clean_text(F.col("html"))).alias("text"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 > 0 THEN (1 + p_partkey % 3)::VARCHAR || 'x' ELSE '' END || 'LP, Album' || CASE WHEN p_partkey % 2 = 0 THEN ', RE, ' || p_type ELSE ', Gat' END || CASE WHEN p_partkey % 5 = 0 THEN ' + CD' ELSE '' END AS text FROM part""")
def s21_format_text(t):
    one = lambda name, qty, words: F.struct(F.lit(name).alias("name"), qty.cast("long").alias("qty"), words.cast("array<string>").alias("descriptions"))
    k = F.col("p_partkey")
    record = one("Vinyl", 1 + k % 3, F.concat(F.array(F.lit("LP"), F.lit("Album")), F.when(k % 2 == 0, F.array(F.lit("Reissue"), F.col("p_type"))).otherwise(F.array(F.lit("Gatefold")))))
    formats = F.when(k % 5 == 0, F.array(record, one("CD", F.lit(1), F.array()))).otherwise(F.array(record))
    return t("part").select("p_partkey", V.format_text(formats).alias("text"))
