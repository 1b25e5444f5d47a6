"""URL filter: rules, and a path-template tree per host for URLs that no rule judges. DataFrame operations only.

A node of the tree is known by the segments above it, as they are after generalising: variable ones by their form, and the
children of a node become one wildcard if they are many and each is rare, so that what stands below them meets too. Sibling
branches, which differ in their last constant segment, merge if their shares of bad labels are not apart by chance's measure.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host and path)
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


def host_path(url: Column) -> tuple[Column, Column]:
    whole = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, whole, 1), UPPER, LOWER), F.regexp_extract(url, whole, 2)


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; nulls if none does."""
    fitting = F.lit(None).cast("string")
    verdict = F.lit(None).cast("string")
    for says, rule in sorted(rules, key=lambda r: len(r[1])):
        h, _, p = rule.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        fitting, verdict = F.when(fits, rule).otherwise(fitting), F.when(fits, says).otherwise(verdict)
    return fitting, verdict


def _shape(s: Column) -> Column:
    """A variable segment by its form alone; others as they are."""
    return (
        F.when(s.rlike(r"^[0-9]+$"), "{n}")
        .when(s.rlike(r"^[0-9]+\.[A-Za-z0-9]{1,5}$"), F.concat(F.lit("{n}."), F.substring_index(s, ".", -1)))
        .when(s.rlike(r"^[0-9]{4}-[0-9]{2}(-[0-9]{2})?$"), "{date}")
        .when(s.rlike(r"^[0-9A-Fa-f-]{16,}$"), "{hex}")
        .otherwise(s)
    )


#: Signs whose runs of three or more count as junk, tags and scripts, and the share of words from which a page is bad.
JUNK, TAGS, SHARE = r"[#$%*@^~|]{3,}", r"(?s)<(script|style)[^>]*>.*?</(script|style)>|<[^>]*>", 0.1


def content_labels(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Labels (host, path, n_bad, n_good) of pages by what they hold: bad where a tenth of the visible words are runs of signs. Null html or no words: no label."""
    host, path = host_path(pages[url_col].cast("string"))
    seen = F.regexp_replace(pages[html_col].cast("string"), TAGS, " ")
    rows = pages.select(host.alias("host"), path.alias("path"), F.regexp_count(seen, F.lit(JUNK)).alias("junk"), F.regexp_count(seen, F.lit(r"\S+")).alias("words")).where("words > 0")
    bad = F.col("junk") >= SHARE * F.col("words")
    return rows.groupBy("host", "path").agg(F.count_if(bad).alias("n_bad"), F.count_if(~bad).alias("n_good"))


def templates(paths: DataFrame, fanout: int = 20, share: float = 0.05) -> DataFrame:
    """(host, path, template) of distinct (host, path, n). Rounds go on until no node's children become wildcards, at most as many as a path has segments: each merges what stands below the last one's."""
    nodes = stored(paths.select("host", "path", "n", F.posexplode(F.split("path", "/")).alias("at", "raw")).select("host", "path", "n", "at", _shape(F.col("raw")).alias("seg")))
    above = Window.partitionBy("host", "path").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    while True:
        held = nodes.withColumn("parent", F.coalesce(F.bit_xor(F.xxhash64("at", "seg")).over(above), F.lit(0)))
        # A hot node's children are counted before they meet at their parent.
        children = held.where("seg <> '*'").groupBy("host", "at", "parent", "seg").agg(F.sum("n").alias("c"))
        parents = children.groupBy("host", "at", "parent").agg(F.sum("c").alias("of"), F.count(F.lit(1)).alias("kids"))
        many = parents.where(f"kids > {fanout}")
        wild = stored(children.join(many, ["host", "at", "parent"]).where(f"c < {share} * of").select("host", "at", "parent", "seg", F.lit(True).alias("wild")))
        if wild.isEmpty():
            break
        named = held.join(wild, ["host", "at", "parent", "seg"], "left")
        nodes = stored(named.select("host", "path", "n", "at", F.when(F.col("wild"), "*").otherwise(F.col("seg")).alias("seg")))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "seg"))), lambda x: x["seg"]), "/")
    return nodes.groupBy("host", "path").agg(joined.alias("template"))


def _family(template: Column) -> Column:
    """The template with its last constant segment as '~'; siblings have the same."""
    parts = F.split(template, "/")
    last = F.array_max(F.transform(parts, lambda x, i: F.when((x == "") | (x == "*") | x.startswith("{"), -1).otherwise(i)))
    return F.array_join(F.transform(parts, lambda x, i: F.when(i == last, "~").otherwise(x)), "/")


def purities(branches: DataFrame, weight: float = 4.0, prior: float = 0.5, z: float = 1.96) -> DataFrame:
    """(host, template, purity) of branches (host, template, bad, of).

    A branch joins its family if its share of bad labels and that of all the family are no further apart than z standard
    errors; the purity of those that joined comes from their labels together, that of any other from its own. One without
    labels joins nothing: its purity is the prior.
    """
    near = lambda p, q, n, m: F.abs(p - q) <= z * F.sqrt(q * (1 - q) * (1 / n + 1 / m)) + 1e-9
    rows = branches.withColumn("family", _family(F.col("template")))
    whole = rows.groupBy("host", "family").agg(F.sum("bad").alias("all_bad"), F.sum("of").alias("all_of"))
    rows = rows.join(whole, ["host", "family"])
    joins = (F.col("of") > 0) & near(F.col("bad") / F.greatest("of", F.lit(1)), F.col("all_bad") / F.greatest("all_of", F.lit(1)), F.greatest("of", F.lit(1)), F.greatest("all_of", F.lit(1)))
    rows = rows.withColumn("joins", joins)
    pooled = rows.where("joins").groupBy("host", "family").agg(F.sum("bad").alias("p_bad"), F.sum("of").alias("p_of"))
    smooth = lambda bad, of: (F.col(bad) + weight * prior) / (F.col(of) + weight)
    return rows.join(pooled, ["host", "family"], "left").select("host", "template", F.when(F.col("joins"), smooth("p_bad", "p_of")).otherwise(smooth("bad", "of")).alias("purity"))


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Sequence[tuple[str, str]] = RULES, labels: DataFrame | None = None, fanout: int = 20, share: float = 0.05, weight: float = 4.0, prior: float = 0.5, reject: float = 0.8, z: float = 1.96) -> DataFrame:
    """Judge every URL by the longest rule that fits, or else by its path template.

    One row per page: page_id, host, path, rule, verdict, template, purity. labels: (host, path, n_bad, n_good), counts of
    bad and good pages; a rule's verdict stands before them where one fits. A template is rejected if its smoothed share of
    bad labels, (bad + weight * prior) / (labelled + weight), is `reject` or more; similar siblings pool their labels.
    Null url or one without "://": host and path empty, judged like any. Null page_id: kept. Repeated rows: each judged,
    each counted. Ties: of rules that fit the longest is one only; a purity of just `reject` is rejected. A very long path:
    each segment is a node of the tree. Other columns, whatever their names, are not read. An empty table: no rows.
    """
    host, path = host_path(F.col("url"))
    rows = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url")).select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    # Rows of one path meet before the shuffle.
    paths = rows.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"))
    known = paths.withColumn("v", verdict)
    if labels is not None:
        more = labels.groupBy("host", "path").agg(F.sum("n_bad").alias("b"), F.sum("n_good").alias("g"))
        known = known.join(more, ["host", "path"], "left")
    else:
        known = known.withColumn("b", F.lit(0)).withColumn("g", F.lit(0))
    said = lambda v, c: F.when(F.col("v") == v, F.col("n")).when(F.col("v").isNull(), F.coalesce(c, F.lit(0))).otherwise(0)
    known = known.select("host", "path", said("block", "b").alias("n_bad"), said("allow", "g").alias("n_good"))
    of_path = stored(templates(paths, fanout, share))
    branches = known.join(of_path, ["host", "path"]).groupBy("host", "template").agg(F.sum("n_bad").alias("bad"), F.sum(F.col("n_bad") + F.col("n_good")).alias("of"))
    scored = of_path.join(purities(branches, weight, prior, z), ["host", "template"]).select("host", "path", "template", "purity")
    out = rows.join(scored, ["host", "path"], "left")
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("purity") >= reject, "block").otherwise("allow")).alias("verdict"), "template", "purity")
