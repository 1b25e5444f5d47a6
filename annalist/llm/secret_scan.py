"""Secret scan with multipart credential linking. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, texts

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: kind: (pattern, group whose length counts, least length, quick test of the text). The first three are reported alone.
KINDS = {
    "assign": (ASSIGN, 2, 8, r"(?i)passw|secret|token|api_?key"),
    "access": (r"AKIA[A-Z0-9]+", 0, 16, r"AKIA"),
    "hex": (r"[0-9a-f]{32,}", 0, 32, r"[0-9a-f]{32}"),
    "weak_access": (r"(?<![A-Za-z0-9+/_=-])(?!AKIA)[A-Z]{2,6}[0-9][A-Z0-9]{8,}(?![A-Za-z0-9+/_=-])", 0, 12, r"[A-Z]{2}[0-9][A-Z0-9]{8}"),
    "weak_secret": (r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])[A-Za-z0-9+/_=-]{20,}", 0, 20, r"[0-9][A-Za-z0-9+/_=-]{3}"),
    "endpoint": (r"(?:https?|s3|jdbc:[a-z]+|mongodb|postgres|redis)://[^\x00-\x20\"'<>]+", 0, 10, r"://"),
}
BASE = ("assign", "access", "hex")
#: A weak candidate, and the kinds of which one must be near it.
COMPLEMENTS = {"weak_access": ("assign", "hex", "weak_secret"), "weak_secret": ("access", "weak_access"), "endpoint": ("assign", "hex", "access")}


def _found(text: Column, kind: str) -> Column:
    pattern, group, _, quick = KINDS[kind]
    parts = F.struct(
        F.lit(kind).alias("kind"),
        F.transform(
            F.arrays_zip(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))),
            lambda x: F.struct(x["0"].alias("gap"), x["1"].alias("hit"), x["2"].alias("held")),
        ).alias("parts"),
    )
    return F.when(text.rlike(quick), parts)


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, h, kind, start, end) of every pattern in (doc_id, text); h tells texts of one id apart. Code points, end exclusive."""
    text = F.col("text")
    h = F.xxhash64("text").alias("h")
    found = docs.where(F.greatest(*[text.rlike(q).cast("int") for *_, q in KINDS.values()]) == 1).select("doc_id", h, F.explode(F.array(*[_found(text, k) for k in KINDS])).alias("f")).where("f is not null")
    parts = found.select("doc_id", "h", "f.kind", F.posexplode("f.parts").alias("i", "p")).where("p.hit is not null").select("doc_id", "h", "kind", "i", F.length("p.gap").alias("gap"), F.length("p.hit").alias("hit"), F.length("p.held").alias("held")).distinct()
    w = Window.partitionBy("doc_id", "h", "kind").orderBy("i")
    least = F.coalesce(*[F.when(F.col("kind") == k, least) for k, (_, _, least, _) in KINDS.items()])
    end = F.sum(F.col("gap") + F.col("hit")).over(w)
    return parts.withColumn("end", end).where(F.col("held") >= least).select("doc_id", "h", "kind", (F.col("end") - F.col("hit")).alias("start"), "end")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = 500) -> DataFrame:
    """Secrets of every text: three kinds that stand alone, and weak candidates with a complementary part within `scope` characters.

    One row per input row: doc_id, spans array<struct<kind, start, end>> by start, then kind as listed. An access
    identifier is complemented by a secret, a secret by an access identifier, an endpoint by either; the parts meet in
    an interval join within their document that stops at the first one. A weak candidate over a base span is left out.
    Null text: empty. Null doc_id: its rows are told apart by text. Repeated rows: the same spans each. Ties: spans of one
    start follow their kinds' order. A very long text: its spans are rows until the end. Other columns, whatever their names,
    are not read. An empty table: no rows.
    """
    docs = texts(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    keyed = docs.select(F.coalesce("doc_id", F.lit(-(2**62))).alias("doc_id"), "text")
    spans = stored(candidates(keyed))
    weak = spans.where(~F.col("kind").isin(*BASE))
    # A candidate is in every bin that it or its scope reaches, a part in those that it covers; so near ones share a bin.
    bins = lambda a, b: F.explode(F.sequence(F.floor(a / scope), F.floor(b / scope))).alias("bin")
    reach = weak.select("*", bins(F.col("start") - scope, F.col("end") + scope))
    binned = spans.select("doc_id", "h", bins(F.col("start"), F.col("end")), F.col("kind").alias("k"), F.col("start").alias("s"), F.col("end").alias("e"))
    near = (F.col("s") - F.col("end") <= scope) & (F.col("start") - F.col("e") <= scope)
    suits = F.lit(False)
    for kind, with_ in COMPLEMENTS.items():
        suits = suits | ((F.col("kind") == kind) & F.col("k").isin(*with_))
    apart = (F.col("e") <= F.col("start")) | (F.col("s") >= F.col("end"))
    linked = _semi(reach, binned, near & suits & apart).drop("bin").distinct()
    over = _semi(reach, binned.where(F.col("k").isin(*BASE)), ~apart).drop("bin").distinct()
    free = linked.join(over, weak.columns, "left_anti").select(weak.columns)
    order = {k: i for i, k in enumerate(KINDS)}
    number = F.coalesce(*[F.when(F.col("kind") == k, i) for k, i in order.items()])
    all_ = spans.where(F.col("kind").isin(*BASE)).unionByName(free).groupBy("doc_id", "h").agg(F.sort_array(F.collect_list(F.struct("start", number.alias("o"), "kind", "end"))).alias("found"))
    keys = docs.select("doc_id", F.coalesce("doc_id", F.lit(-(2**62))).alias("key"), F.xxhash64("text").alias("h"))
    out = keys.join(all_.withColumnRenamed("doc_id", "key"), ["key", "h"], "left")
    shaped = F.transform("found", lambda x: F.struct(x["kind"].alias("kind"), x["start"].cast("long").alias("start"), x["end"].cast("long").alias("end")))
    return out.select("doc_id", F.coalesce(shaped, F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")).alias("spans"))


def _semi(left: DataFrame, right: DataFrame, condition: Column) -> DataFrame:
    r = right.select(F.col("doc_id").alias("d_"), F.col("h").alias("h_"), F.col("bin").alias("b_"), "k", "s", "e")
    return left.join(r, (F.col("doc_id") == F.col("d_")) & (F.col("h") == F.col("h_")) & (F.col("bin") == F.col("b_")) & condition, "left_semi")


def digests(scanned: DataFrame, kinds: tuple[str, ...] = BASE) -> DataFrame:
    """Counts and digests of spans: n_<kind>, base_sha256 of the base spans, spans as text."""
    joined = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("spans", lambda x: x["kind"].isin(*kinds))
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return scanned.select("doc_id", *[count(k) for k in kinds], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
