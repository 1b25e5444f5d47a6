"""The training-data operators as queries over the given tables, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, exact, jaccard, licences, packing, personal, quality, search, secret_scan, substrings, toxicity, trie, urls

VOCABULARY = "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_benchmark_decontamination(spark: SparkSession, d: str) -> DataFrame:
    return decontaminate.overlaps(table(spark, d, "documents"), table(spark, d, "benchmark"))


def op2_substring_dedup(spark: SparkSession, d: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, d, "documents"), n_words=13).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op3_pii(spark: SparkSession, d: str) -> DataFrame:
    return personal.digests(personal.find(table(spark, d, "documents")))


def op4_exact_dedup(spark: SparkSession, d: str) -> DataFrame:
    return exact.dedup(table(spark, d, "documents"), keep="largest")


def op5_url_filter(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages")
    return urls.judge(pages, labels=urls.content_labels(pages)).select("page_id", "host", "path", "rule", "verdict")


def op6_quality_classifier(spark: SparkSession, d: str) -> DataFrame:
    return quality.score(table(spark, d, "documents")).select("doc_id", F.round("score", 6).alias("score"), "keep")


def op7_license_scan(spark: SparkSession, d: str) -> DataFrame:
    return licences.scan(table(spark, d, "documents"))


def op8_packing(spark: SparkSession, d: str) -> DataFrame:
    return packing.digests(packing.pack(table(spark, d, "documents"), vocabulary()))


def op9_ngram_jaccard_join(spark: SparkSession, d: str) -> DataFrame:
    return jaccard.link(table(spark, d, "documents"))


def op10_secret_scan(spark: SparkSession, d: str) -> DataFrame:
    return secret_scan.digests(secret_scan.scan(table(spark, d, "documents")))


def op11_ranked_search(spark: SparkSession, d: str) -> DataFrame:
    return search.rank(table(spark, d, "documents"), table(spark, d, "benchmark"))


def op12_toxicity(spark: SparkSession, d: str) -> DataFrame:
    return toxicity.score(table(spark, d, "documents"), table(spark, d, "labels"))


def op13_conversation_trie(spark: SparkSession, d: str) -> DataFrame:
    return trie.trie(table(spark, d, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_benchmark_decontamination, op2_substring_dedup, op3_pii, op4_exact_dedup, op5_url_filter, op6_quality_classifier, op7_license_scan, op8_packing, op9_ngram_jaccard_join, op10_secret_scan, op11_ranked_search, op12_toxicity, op13_conversation_trie)
}

_WORDS = r"regexp_extract_all(text, '[^\x20\x09-\x0D]+')"

_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
#: crc32 of the decimal number c: a byte is taken in, then eight times a bit shifted out.
_CRC32 = "xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(c::VARCHAR, ''), lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295)"

ORACLE_SQL = {
    "op2_substring_dedup": rf"""
WITH w AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM w WHERE len(w) >= 13),
g AS (SELECT doc_id, i, md5(array_to_string(w[i:i+12], ' ')) AS h FROM p),
f AS (SELECT h, min(doc_id) AS first FROM g GROUP BY h),
m AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM g JOIN f USING (h) WHERE doc_id > first),
r AS (SELECT doc_id, list(i) AS gone FROM m GROUP BY doc_id),
k AS (SELECT w.doc_id, w, coalesce(gone, []) AS gone FROM w LEFT JOIN r ON w.doc_id = r.doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, len(gone)::BIGINT AS n_removed,
       sha256(array_to_string(list_filter(w, lambda x, i: NOT list_contains(gone, i)), ' ')) AS kept_sha256 FROM k""",
    "op4_exact_dedup": """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id, count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept, sha256(coalesce(text, '')) AS text_sha256 FROM documents""",
    "op7_license_scan": licences.oracle(),
    "op11_ranked_search": rf"""
WITH t AS (SELECT doc_id, unnest({_TERMS}) AS t FROM documents),
p AS (SELECT doc_id, t, count(*) AS tf FROM t GROUP BY ALL),
n AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM p GROUP BY ALL),
g AS (SELECT count(*)::BIGINT AS nd, sum(n)::BIGINT AS nl FROM n),
d AS (SELECT t, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, g GROUP BY t, nd),
i AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS t FROM benchmark),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nd) // nl))))::BIGINT AS score
      FROM i JOIN d USING (t) JOIN p USING (t) JOIN n USING (doc_id), g GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 50""",
    "op13_conversation_trie": f"""
WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS p
           FROM conversations WHERE conv_id IS NOT NULL),
h AS (SELECT c, c - c % 5 AS base, {_CRC32} % 9 AS h FROM (SELECT DISTINCT c FROM t)),
u AS (SELECT h.c, 0 AS own, t.p, r, x FROM h JOIN t ON t.c = h.base AND t.p <= h.h
      UNION ALL SELECT h.c, 1, t.p, r, x FROM h JOIN t ON t.c = h.c AND t.p > h.h),
l AS (SELECT c, list(struct_pack(r := r, x := x) ORDER BY own, p) AS l FROM u GROUP BY c),
f AS (SELECT h.c, coalesce(l, []) AS l FROM h LEFT JOIN l ON h.c = l.c),
d AS (SELECT c, l, unnest(range(len(l) + 1)) AS depth FROM f),
k AS (SELECT c, depth, sha256(l[:depth]::VARCHAR) AS node, CASE WHEN depth > 0 THEN sha256(l[:depth - 1]::VARCHAR) END AS parent,
             CASE WHEN depth > 0 THEN strlen(l[depth].x) ELSE 0 END AS size, depth = len(l) AS ends FROM d),
n AS (SELECT depth, node, parent, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(size) AS worth,
             sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256 FROM k GROUP BY ALL),
m AS (SELECT depth + 1 AS depth, node AS parent, conv_id AS parent_conv_id FROM n),
q AS (SELECT depth - 1 AS depth, parent AS node, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
a AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN q ON n.depth = q.depth AND n.node = q.node),
s AS (SELECT k.depth, k.node, sum(worth) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves
      FROM a JOIN k ON k.c = a.conv_id AND k.depth <= a.depth GROUP BY ALL)
SELECT conv_id::BIGINT AS conv_id, a.depth::BIGINT AS depth, parent_conv_id::BIGINT AS parent_conv_id, n_convs::BIGINT AS n_convs, n_children::BIGINT AS n_children,
       n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, ends_sha256
FROM a LEFT JOIN m ON a.depth = m.depth AND a.parent = m.parent JOIN s ON a.depth = s.depth AND a.node = s.node""",
}
