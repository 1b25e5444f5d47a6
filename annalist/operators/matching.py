"""Fuzzy matching in bulk: pairs of near texts by a lossless prefilter and an exact ratio, the nearest known rows of new ones, scores of candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from annalist.functions.ratios import indel_ratio, sequence_ratio, token_set_ratio, token_sort_ratio
from annalist.functions.text import name_key
from annalist.functions.titles import comparison_words, differing_words, no_item_kind, title_keys
from annalist.operators.curation import cut
from annalist.operators.entities import near_pairs
from annalist.operators.similar import near_between, word_set_pairs


def pair_scores(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Add indel, token_set, token_sort and sequence, ratios of 0 to 100 of two text columns."""
    x, y = F.col(a), F.col(b)
    return pairs.withColumns({"indel": indel_ratio(x, y), "token_set": token_set_ratio(x, y), "token_sort": token_sort_ratio(x, y), "sequence": sequence_ratio(x, y)})


def near_texts(df: DataFrame, text: str, ratio: int, block: str | None = None) -> DataFrame:
    """(block, x, y, ratio), both ways: different texts of a block whose indel ratio is `ratio` (84 or more) or higher.

    An indel distance d of m + n characters is no less than the Levenshtein distance, so a ratio of r leaves a Levenshtein
    similarity of 2 r - 100 percent or more, and the prefilter by shared bigrams loses no pair.
    """
    assert ratio >= 84
    block_ = F.col(block).cast("string") if block else F.lit("")
    t = df.where(F.col(text).isNotNull() & (F.col(text) != "")).select(F.coalesce(block_, F.lit("")).alias("b_"), F.col(text).alias("t_")).distinct().withColumn("id_", F.struct("b_", "t_"))
    pairs = near_pairs(t, "id_", "t_", 2 * ratio - 100, "b_").select(F.col("block"), F.col("a.t_").alias("x"), F.col("b.t_").alias("y")).withColumn("ratio", indel_ratio("x", "y")).where(F.col("ratio") >= ratio)
    return pairs.unionByName(pairs.select("block", F.col("y").alias("x"), F.col("x").alias("y"), "ratio"))


def fuzzy_pairs(df: DataFrame, key: str, text: str, ratio: int, block: str | None = None, dismissed: DataFrame | None = None, shortest: int = 0) -> DataFrame:
    """(a, b, ratio), a < b: rows whose texts are equal or near, of `shortest` characters or more, but for dismissed pairs (a, b). Copies of one text stand under its smallest key, with their number in copies_a and copies_b; equal texts are a pair of the smallest and the next key."""
    block_ = F.coalesce(F.col(block).cast("string"), F.lit("")) if block else F.lit("")
    t = df.where(F.length(text) >= max(1, shortest)).select(F.col(key).alias("k_"), F.col(text).alias("t_"), block_.alias("block"))
    held = t.groupBy("block", "t_").agg(F.min("k_").alias("k"), F.count(F.lit(1)).alias("n"))
    next_ = t.join(held.where("n > 1"), ["block", "t_"]).where("k_ > k").groupBy("block", "t_").agg(F.min("k").alias("a"), F.min("k_").alias("b"), F.min("n").alias("n"))
    same = next_.select("a", "b", F.lit(100.0).alias("ratio"), F.col("n").alias("copies_a"), F.col("n").alias("copies_b"))
    side = lambda x, s: held.select("block", F.col("t_").alias(x), F.col("k").alias(f"k{s}"), F.col("n").alias(f"n{s}"))
    near = near_texts(t, "t_", ratio, "block").join(side("x", "1"), ["block", "x"]).join(side("y", "2"), ["block", "y"]).where("k1 < k2")
    out = same.unionByName(near.select(F.col("k1").alias("a"), F.col("k2").alias("b"), "ratio", F.col("n1").alias("copies_a"), F.col("n2").alias("copies_b")))
    if dismissed is not None:
        out = out.join(dismissed.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), ["a", "b"], "left_anti")
    return out


def nearest(new: DataFrame, known: DataFrame, key: str, text: str, ratio: int, k: int = 8, block: str | None = None) -> DataFrame:
    """(key, match, ratio, nth): for each new row its k best known rows of the same block, best ratio first, then smallest key. Of known rows with one text the smallest key stands for all. New rows are only compared with known ones."""
    block_ = F.coalesce(F.col(block).cast("string"), F.lit("")) if block else F.lit("")
    n = new.select(F.col(key).alias("new_"), F.col(text).alias("x"), block_.alias("block"))
    old = known.select(F.col(key).alias("k_"), F.col(text).alias("y"), block_.alias("block")).groupBy("block", "y").agg(F.min("k_").alias("match"))
    near = near_between(n.select("block", F.col("x").alias("t")), old.select("block", F.col("y").alias("t")), ratio)
    met = n.join(near, ["block", "x"]).join(old, ["block", "y"])
    place = F.row_number().over(Window.partitionBy("new_").orderBy(F.desc("ratio"), "match"))
    return met.select(F.col("new_").alias(key), "match", "ratio", place.alias("nth")).where(F.col("nth") <= k)


def list_overlap(items: DataFrame, parent: str, item: str, pairs: DataFrame) -> DataFrame:
    """pairs (a, b, ...) with overlap: percent of the smaller parent's items that the other has too; null if either has none."""
    d = items.select(parent, item).distinct()
    size = d.groupBy(parent).agg(F.count(F.lit(1)).alias("n"))
    p = pairs.select("a", "b").distinct()
    shared = p.join(d.select(F.col(parent).alias("a"), F.col(item).alias("i_")), "a").join(d.select(F.col(parent).alias("b"), F.col(item).alias("i_")), ["b", "i_"]).groupBy("a", "b").agg(F.count(F.lit(1)).alias("s_"))
    out = pairs.join(shared, ["a", "b"], "left").join(size.select(F.col(parent).alias("a"), F.col("n").alias("na_")), "a", "left").join(size.select(F.col(parent).alias("b"), F.col("n").alias("nb_")), "b", "left")
    share = F.round(100 * F.coalesce("s_", F.lit(0)) / F.least("na_", "nb_"), 4)
    return out.select(*pairs.columns, F.when(F.col("na_").isNotNull() & F.col("nb_").isNotNull(), share).alias("overlap"))


def parent_pairs(parents: DataFrame, items: DataFrame, key: str, title: str, item: str, owner: str, ratio: int = 90, shortest: int = 4, dismissed: DataFrame | None = None) -> DataFrame:
    """Duplicate parents of one owner: fuzzy_pairs() of their titles with the overlap of their items."""
    pairs = fuzzy_pairs(parents, key, title, ratio, owner, dismissed, shortest)
    return list_overlap(items, key, item, pairs)


def actor_pairs(actors: DataFrame, key: str, name: str, ext: str, ratio: float = 92, shortest: int = 8, dismissed: DataFrame | None = None, titles: DataFrame | None = None) -> DataFrame:
    """(a, b, ratio, same_name, shared), a < b: duplicate actors. Names of `shortest` characters whose word-set ratio, case and signs aside, is `ratio` or more, and names with one normal form (100), whatever their length.

    Two that carry different external ids are no pair, nor are dismissed ones (a, b). Of actors with one name the one with
    the smallest key stands for all in pairs with others, and is in a pair with each. shared: how many titles (key, title)
    both have; null without titles.
    """
    t = actors.select(F.col(key).alias("k_"), F.col(ext).cast("string").alias("x_"), F.length(name).alias("n_"), F.trim(F.lower(F.regexp_replace(name, r"[^\p{L}\p{N}]+", " "))).alias("t"), name_key(F.col(name)).alias("norm_"))
    first = lambda c, of: of.groupBy(c).agg(F.min("k_").alias("f_"))
    star = lambda c, of: of.join(first(c, of), c).where("k_ > f_").select(F.col("f_").alias("a"), F.col("k_").alias("b"), F.lit(100.0).alias("ratio"))
    long = t.where((F.col("n_") >= shortest) & (F.col("t") != ""))
    side = lambda x, c: first("t", long).select(F.col("t").alias(x), F.col("f_").alias(c))
    near = word_set_pairs(long.select(F.lit("").alias("block"), "t"), ratio).join(side("x", "a_"), "x").join(side("y", "b_"), "y").select(F.least("a_", "b_").alias("a"), F.greatest("a_", "b_").alias("b"), "ratio")
    found = star("norm_", t.where("norm_ <> ''")).unionByName(star("t", long)).unionByName(near).groupBy("a", "b").agg(F.max("ratio").alias("ratio"))
    of = lambda c: t.select(F.col("k_").alias(c), F.col("x_").alias(f"x{c}_"), F.col("norm_").alias(f"norm{c}_"))
    met = found.join(of("a"), "a").join(of("b"), "b").where("xa_ is null or xb_ is null or xa_ = xb_")
    if dismissed is not None:
        met = met.join(dismissed.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), ["a", "b"], "left_anti")
    out = met.select("a", "b", "ratio", F.coalesce(F.col("norma_") == F.col("normb_"), F.lit(False)).alias("same_name"))
    if titles is None:
        return out.withColumn("shared", F.lit(None).cast("long"))
    d = titles.select("key", "title").where("title is not null").distinct()
    both = out.select("a", "b").join(d.select(F.col("key").alias("a"), "title"), "a").join(d.select(F.col("key").alias("b"), "title"), ["b", "title"]).groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))
    return out.join(both, ["a", "b"], "left").withColumn("shared", F.coalesce("shared", F.lit(0)))


def possible_pairs(items: DataFrame, key: str, owner: str, title: str, dismissed: DataFrame | None = None, spelling: float = 85) -> DataFrame:
    """(owner, a, b, reason, score), a < b: titles of one owner that are likely one item, though their keys differ, and why; never those with different sequel numbers (a year as in '95 is none) or with words more.

    reason, the first that holds: spacing (100: the same without blanks), article (97: but for a, an, the), suffix (95: but
    for one or two numbers at either end, with keys of four characters), spelling (the ratio of the words that differ, once
    those shared at both ends are set aside, is `spelling` or more, 85 at least, and they have three characters). Titles of
    one key stand under the smallest item; those of under four characters, and lines that are no item, are left out, as are
    dismissed pairs (a, b). Titles meet on what the reasons leave of them, and on rare bigrams.
    """
    t = title_keys(items.where(F.col(title).isNotNull()), title)
    t = t.withColumn("sequel", F.when(~F.trim("base").rlike("['’‘][0-9]{2}$"), F.col("sequel")))  # a year, not a sequel
    t = t.withColumn("k_", F.coalesce(F.nullif("track_key", F.lit("")), "key")).where((F.col("k_") != "") & no_item_kind(F.col(title)).isNull())
    t = t.groupBy(F.col(owner).alias("owner"), "k_").agg(F.min(key).alias("id"), F.min_by("sequel", key).alias("seq_")).withColumn("words", comparison_words(F.col("k_"))).withColumn("c_", F.array_join("words", "")).where("length(c_) >= 4")
    t = t.withColumns({"seq_": F.coalesce("seq_", F.lit("")), "block": F.to_json(F.struct(F.col("owner").cast("string").alias("o"), F.coalesce("seq_", F.lit("")).alias("s")))})
    t = cut(t.select("block", "owner", "id", "k_", "words", "c_"))  # titles are taken apart once
    article = lambda w: w.isin("a", "an", "the")
    number = lambda w: w.rlike("^[0-9]{1,4}$")
    bare = {"c_": F.col("c_"), "no_article": F.array_join(F.filter("words", lambda w: ~article(w)), " "), "no_number": F.array_join(F.filter("words", lambda w: ~number(w)), " ")}
    keyed = t.select("block", "id", F.explode(F.array(*[F.concat(F.lit(f"{n} "), c) for n, c in bare.items()])).alias("x"))
    met = keyed.join(keyed.withColumnRenamed("id", "id2"), ["block", "x"]).where("id < id2").select("block", "id", "id2")
    texts = t.select("block", F.col("c_").alias("t"))
    near = near_between(texts, texts, 80).where("x < y").select("block", "x", "y")
    of = lambda x, i: t.select("block", F.col("c_").alias(x), F.col("id").alias(i))
    near = near.join(of("x", "i1"), ["block", "x"]).join(of("y", "i2"), ["block", "y"]).select("block", F.least("i1", "i2").alias("id"), F.greatest("i1", "i2").alias("id2"))
    both = met.unionByName(near).distinct()
    if dismissed is not None:
        both = both.join(dismissed.select(F.least("a", "b").alias("id"), F.greatest("a", "b").alias("id2")).distinct(), ["id", "id2"], "left_anti")
    side = lambda n: t.select("block", "owner", F.col("id").alias("id" if n == 1 else "id2"), F.col("k_").alias(f"k{n}"), F.col("words").alias(f"w{n}"), F.col("c_").alias(f"c{n}"))
    pairs = both.join(side(1), ["block", "id"]).join(side(2).drop("owner"), ["block", "id2"]).withColumn("d", differing_words(F.col("w1"), F.col("w2")))
    extra = F.when(F.size("d.a") == 0, F.col("d.b")).when(F.size("d.b") == 0, F.col("d.a"))
    left, right = F.array_join("d.a", " "), F.array_join("d.b", " ")
    long = (F.length("k1") >= 4) & (F.length("k2") >= 4)
    reason = (
        F.when(F.col("c1") == F.col("c2"), "spacing").when(F.forall(extra, article), "article")
        .when((F.size(extra) <= 2) & F.forall(extra, number) & long, "suffix").when(extra.isNull() & (F.least(F.length(left), F.length(right)) >= 3), "spelling")
    )
    judged = pairs.select("owner", F.col("id").alias("a"), F.col("id2").alias("b"), reason.alias("reason"), left.alias("x_"), right.alias("y_")).where("reason is not null")
    sure = judged.where("reason <> 'spelling'").withColumn("score", F.when(F.col("reason") == "spacing", 100.0).when(F.col("reason") == "article", 97.0).otherwise(95.0))
    spelt = judged.where("reason = 'spelling'").withColumn("score", F.round(indel_ratio("x_", "y_"), 1)).where(F.col("score") >= max(85, spelling))
    return sure.unionByName(spelt).select("owner", "a", "b", "reason", "score")


def similar_versions(parents: DataFrame, key: str, owner: str, title_key: str, sequel: str, dismissed: DataFrame | None = None, ratio: float = 92, shortest: int = 4) -> DataFrame:
    """(owner, a, b, ratio), a < b: hints at parents of one owner whose titles, `shortest` characters or longer, have nearly the same words and the same sequel number, but are not the same. Two that are each in a group of one title already are none."""
    p = parents.select(F.col(owner).alias("owner"), F.col(key).alias("k_"), F.col(title_key).alias("t"), F.coalesce(F.col(sequel).cast("string"), F.lit("")).alias("s_")).where(F.length("t") >= shortest)
    grouped = p.groupBy("owner", "t").agg(F.count(F.lit(1)).alias("n_"))
    p = p.join(grouped, ["owner", "t"]).withColumn("block", F.to_json(F.struct(F.col("owner").cast("string").alias("o"), "s_")))
    side = lambda x, c: p.select("block", "owner", F.col("t").alias(x), F.col("k_").alias(c), F.col("n_").alias(f"n{c}"))
    met = word_set_pairs(p.select("block", "t"), ratio).join(side("x", "a_"), ["block", "x"]).join(side("y", "b_").drop("owner"), ["block", "y"]).where("na_ = 1 or nb_ = 1")
    out = met.select("owner", F.least("a_", "b_").alias("a"), F.greatest("a_", "b_").alias("b"), "ratio")
    return out if dismissed is None else out.join(dismissed.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), ["a", "b"], "left_anti").select("owner", "a", "b", "ratio")


def score_actors(candidates: DataFrame, entity: str) -> DataFrame:
    """Candidates (entity, candidate, local, name, search, titles, matched) with confidence and tier.

    local, name: folded names; search: the source's own score; titles, matched: how many of the entity's titles were looked
    up and found with the candidate, null if not looked up. Weights: name 0.45, search 0.20, titles 0.35; without titles name
    0.6 and search 0.4. high: equal names and two in five titles, or, without titles, the only one of that name and a search
    score of 95. medium: 75 or more, unless several have that name and no title speaks for this one.

    Candidates may have ratio and alike instead of local and name: the names' ratio, and how many of the entity's have its name.
    """
    if "alike" in candidates.columns:
        df = candidates.withColumns({"sim": F.col("ratio"), "exact_": F.col("alike")})
    else:
        exact = F.sum((F.col("name") == F.col("local")).cast("int")).over(Window.partitionBy(entity))
        df = candidates.withColumns({"sim": F.when(F.col("name") == F.col("local"), 100.0).otherwise(indel_ratio("local", "name")), "exact_": exact})
    share = F.when((F.col("titles") > 0) & F.col("matched").isNotNull(), F.col("matched") / F.col("titles"))
    df = df.withColumn("share_", share).withColumn("confidence", F.coalesce(0.45 * F.col("sim") + 0.20 * F.col("search") + 35 * F.col("share_"), 0.6 * F.col("sim") + 0.4 * F.col("search")))
    high = (F.col("sim") == 100) & F.coalesce(F.col("share_") >= 0.4, (F.col("exact_") == 1) & (F.col("search") >= 95))
    medium = (F.col("confidence") >= 75) & ~((F.col("exact_") > 1) & (F.coalesce("share_", F.lit(0)) <= 0))
    return df.select(entity, "candidate", F.round("confidence", 1).alias("confidence"), F.when(high, "high").when(medium, "medium").otherwise("low").alias("tier"))


def _parent_terms(candidates: DataFrame) -> DataFrame:
    """Candidates of score_parents() with exact_, score_, pct_ and strong_."""
    if "ratio" in candidates.columns:
        df = candidates.withColumn("exact_", F.col("ratio") == 100).withColumn("score_", F.round("ratio", 1))
    else:
        df = candidates.withColumn("exact_", F.col("local") == F.col("title")).withColumn("score_", F.when(F.col("exact_"), 100.0).otherwise(F.round(indel_ratio("local", "title"), 1)))
    df = df.withColumn("pct_", F.when((F.col("played") > 0) & F.col("matched").isNotNull(), F.round(100 * F.col("matched") / F.col("played"))))
    df = df.where(F.col("exact_") | F.coalesce(F.col("pct_") >= 20, F.lit(True)))
    return df.withColumn("strong_", F.col("exact_") & ~F.col("conflict") & (F.coalesce("pct_", F.lit(0.0)) >= 50))


def strong_parents(candidates: DataFrame, entity: str) -> DataFrame:
    """(entity, strong): how many candidates have the same title, no conflict and half of the items; entities without any are left out."""
    return _parent_terms(candidates).where("strong_").groupBy(entity).agg(F.count(F.lit(1)).alias("strong"))


def score_parents(candidates: DataFrame, entity: str) -> DataFrame:
    """Candidates (entity, candidate, local, title, played, matched, conflict) with confidence and tier.

    local, title: folded titles; played, matched: how many of the items played stand on the candidate's list, null if there is
    none; conflict: whether its type can't be right. 0.5 of the title's ratio, 0.4 of the overlap (half of it where unknown), 10
    without a conflict. A near title with under a fifth of the items is left out. high: the only candidate of the same title,
    without a conflict, with half of the items.

    Candidates may have ratio, of their titles, and strong, as strong_parents() counts them, instead of local and title.
    """
    df = _parent_terms(candidates)
    pct = F.coalesce("pct_", F.lit(0.0))
    alone = (F.col("strong") if "strong" in candidates.columns else F.sum(F.col("strong_").cast("int")).over(Window.partitionBy(entity))) == 1
    medium = ~F.col("conflict") & ((F.col("exact_") & F.coalesce(F.col("pct_") >= 20, F.lit(True))) | (pct >= 50))
    confidence = 0.5 * F.col("score_") + 0.4 * F.coalesce("pct_", F.lit(50.0)) + F.when(F.col("conflict"), 0).otherwise(10)
    return df.select(entity, "candidate", F.round(confidence, 1).alias("confidence"), F.when(F.col("strong_") & alone, "high").when(medium, "medium").otherwise("low").alias("tier"))


def fuzzy_search(queries: DataFrame, table: DataFrame, key: str, text: str, weight: str, ratio: int = 84, k: int = 10) -> DataFrame:
    """(query, key, band, nth) of a table of queries (query): rows whose text is the query (0), begins with it (1), is near it (2) or has all its words (3); heavier rows first within a band.

    Rows meet queries by their longest word and by rare bigrams, so that neither table is paired with the other, nor with itself.
    """
    q = queries.select("query").distinct().withColumn("words_", F.array_distinct(F.split("query", " ")))
    t = table.select(F.col(key).alias("k_"), F.col(text).alias("t_"), F.col(weight).alias("w_"))
    rarest = F.array_max(F.transform("words_", lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    held = t.select("*", F.explode(F.array_distinct(F.split("t_", " "))).alias("word_"))
    by_word = q.withColumn("word_", rarest).join(held, "word_").where(F.forall("words_", lambda w: F.array_contains(F.split("t_", " "), w)))
    by_word = by_word.select("query", "k_", "w_", F.when(F.col("t_") == F.col("query"), 0).when(F.startswith("t_", "query"), 1).otherwise(3).alias("band"))
    one = F.lit("").alias("block")
    near = near_between(q.select(one, F.col("query").alias("t")), t.select(one, F.col("t_").alias("t")), ratio).join(t.withColumnRenamed("t_", "y"), "y").select(F.col("x").alias("query"), "k_", "w_", F.lit(2).alias("band"))
    best = by_word.unionByName(near).groupBy("query", "k_", "w_").agg(F.min("band").alias("band"))
    place = F.row_number().over(Window.partitionBy("query").orderBy("band", F.desc("w_"), "k_"))
    return best.select("query", F.col("k_").alias(key), "band", place.alias("nth")).where(F.col("nth") <= k)

