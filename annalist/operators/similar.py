"""Joins by similarity between two sides, or of a table with itself, that never pair a table: rows meet on their rarest parts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist.functions.ratios import indel_ratio, sequence_ratio


def _grams(padded: Column, length: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), length), lambda i: F.substr(padded, i, F.lit(2)))


def _counted(parts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows of parts (by, p_) with i_, which tells the copies of one part apart."""
    c = parts.groupBy(*by, "p_").agg(F.count(F.lit(1)).alias("c_"))
    return c.select(*by, "p_", F.explode(F.sequence(F.lit(1), F.col("c_").cast("int"))).alias("i_"))


def _prefixes(parts: DataFrame, by: Sequence[str], often: DataFrame, length: Column) -> DataFrame:
    """The `length` parts of each row that fewest rows have, and their place at_ among them. Parts that no row of the other side has are among them, though they meet nothing: each takes a place that an edit may have spoilt."""
    ranked = parts.join(often, ["block", "p_", "i_"]).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("f_", "p_", "i_"))).alias("all_"))
    return ranked.select(*by, F.posexplode(F.slice("all_", F.lit(1), length.cast("int"))).alias("at_", "x_")).select(*by, "x_.p_", "x_.i_", "at_")


def near_between(left: DataFrame, right: DataFrame, ratio: float) -> DataFrame:
    """(block, x, y, ratio): texts of left (block, t) and of right whose indel ratio is `ratio` or more, equal ones too.

    Texts of m and n characters with a ratio of r are (1 - r) (m + n) insertions and deletions apart at most, of as many
    as m + n if that is odd or even, and each spoils two bigrams of a text at most. So of twice as many and one of a text's
    rarest bigrams the other has one among its own. Only such pairs are compared, and only across the sides: rows of one
    side never meet each other. Lengths that leave no edit, or that the other side lacks, meet no bigrams: equal texts meet
    as a whole. Null and empty texts meet nothing. ratio: 80 or more; below that there may be no bigram in common.
    """
    assert 80 <= ratio <= 100
    r = ratio / 100

    def side(df: DataFrame) -> DataFrame:
        return df.where(F.col("t").isNotNull() & (F.col("t") != "")).select(F.coalesce(F.col("block").cast("string"), F.lit("")).alias("block"), "t").distinct().withColumn("n_", F.length("t"))

    def edits(m: str, n: str) -> Column:
        """As many as the ratio allows two texts of such lengths."""
        most = F.floor((1 - r) * (F.col(m) + F.col(n)) + 1e-9)
        return most - (most + F.col(m) + F.col(n)) % 2

    a, b = side(left), side(right)
    reach = F.sequence(F.ceil(F.col("m_") * r / (2 - r) - 1e-9).cast("int"), F.floor(F.col("m_") * (2 - r) / r + 1e-9).cast("int"))
    lengths = a.select("block", F.col("n_").alias("m_")).distinct().select("block", "m_", F.explode(reach).alias("n_")).join(b.select("block", "n_").distinct(), ["block", "n_"])
    lengths = lengths.withColumn("e_", edits("m_", "n_")).where("e_ > 0")
    most = lambda n: lengths.groupBy("block", F.col(n).alias("n_")).agg(F.max("e_").alias("e_"))
    padded = F.concat(F.lit("\x01"), F.col("t"), F.lit("\x02"))
    grams = lambda t, n: _counted(t.join(most(n), ["block", "n_"]).select("block", "t", "n_", "e_", F.explode(_grams(padded, F.col("n_") + 1)).alias("p_")), ["block", "t", "n_", "e_"])
    ga, gb = grams(a, "m_"), grams(b, "n_")
    often = ga.select("block", "p_", "i_").unionByName(gb.select("block", "p_", "i_")).groupBy("block", "p_", "i_").agg(F.count(F.lit(1)).alias("f_"))
    length = 2 * F.col("e_") + 1
    x = _prefixes(ga, ["block", "t", "n_", "e_"], often, length).select("block", "p_", "i_", F.col("t").alias("x"), F.col("n_").alias("m_"), F.col("at_").alias("u_"))
    y = _prefixes(gb, ["block", "t", "n_", "e_"], often, length).select("block", "p_", "i_", F.col("t").alias("y"), "n_", F.col("at_").alias("v_"))
    sized = F.least("m_", "n_") * (2 - r) + 1e-9 >= F.greatest("m_", "n_") * r
    pairs = x.join(y, ["block", "p_", "i_"]).where(sized & (F.greatest("u_", "v_") <= 2 * edits("m_", "n_")) & (edits("m_", "n_") > 0) & (F.col("x") != F.col("y"))).select("block", "x", "y").distinct()
    same = a.select("block", F.col("t").alias("x")).join(b.select("block", F.col("t").alias("x"), F.col("t").alias("y")), ["block", "x"]).select("block", "x", "y", F.lit(100.0).alias("ratio"))
    return same.unionByName(pairs.withColumn("ratio", indel_ratio("x", "y")).where(F.col("ratio") >= ratio))


def word_set_pairs(names: DataFrame, ratio: float = 92, candidates: bool = False) -> DataFrame:
    """(block, x, y, ratio), x < y: names (block, t) of one block whose word-set ratio is `ratio` or more.

    That ratio is the best indel ratio among the words both have (s), these with what x has besides, and these with what y
    has besides, all sorted; 100 if one's words are all the other's. Two ways lead to it, each with its own index:

    Words: if s alone makes the ratio with one side, the words that this side has besides are few, by length. So s holds
    one of the rarest of that side's words that together are longer than those may be; it meets the names that have it. The
    lengths of s and of both sides then say the ratio, without comparing a character. A word that many names have is met
    only by names that have none but such words.

    Bigrams: else few characters differ between both whole names, whose words may stand in any order; bigrams within and
    around words do not depend on that order, so each name meets others on its rarest ones.

    ratio: 80 or more. candidates: return what met, unjudged. Names that are equal but for order or repeats of their words have ratio 100.
    Null and blank names: no words, in no pair. Names are compared as they are; fold them before.
    """
    assert 80 <= ratio <= 100
    r = ratio / 100
    words = F.array_sort(F.array_distinct(F.filter(F.split("t", r"\s+"), lambda w: w != "")))
    t = names.select(F.coalesce(F.col("block").cast("string"), F.lit("")).alias("block"), "t").distinct().withColumn("w_", words).where("size(w_) > 0").withColumn("n_", F.length(F.array_join("w_", " ")))

    # By words.
    held = t.select("block", "t", "n_", F.explode("w_").alias("p_")).withColumn("i_", F.lit(1))
    often = held.groupBy("block", "p_", "i_").agg(F.count(F.lit(1)).alias("f_"))
    ranked = held.join(often, ["block", "p_", "i_"]).groupBy("block", "t", "n_").agg(F.array_sort(F.collect_list(F.struct("f_", "p_"))).alias("all_"))
    # |s| >= r / (2 - r) of the side's length, so the words besides have, with their blanks, the rest at most.
    spare = F.floor(F.col("n_") * (1 - r / (2 - r)) + 1e-9)
    ahead = F.transform("all_", lambda x, i: F.struct(x["p_"].alias("p_"), F.aggregate(F.slice("all_", F.lit(1), i), F.lit(0), lambda s, y: s + F.length(y["p_"]) + 1).alias("before")))
    opening = ranked.select("block", F.col("t").alias("x"), spare.alias("spare_"), F.explode(ahead).alias("o_")).where("o_.before <= spare_").select("block", "x", F.col("o_.p_").alias("p_"))
    by_word = opening.join(held.select("block", "p_", F.col("t").alias("y")), ["block", "p_"]).where("x <> y").select("block", F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))

    # By bigrams.
    padded = F.flatten(F.transform("w_", lambda w: _grams(F.concat(F.lit(" "), w, F.lit(" ")), F.length(w) + 1)))
    grams = _counted(t.select("block", "t", "n_", F.explode(padded).alias("p_")), ["block", "t", "n_"])
    often = grams.groupBy("block", "p_", "i_").agg(F.count(F.lit(1)).alias("f_"))
    edits = F.floor((1 - r) * (F.col("n_") + F.floor(F.col("n_") * (2 - r) / r + 1e-9)) + 1e-9)
    pre = _prefixes(grams, ["block", "t", "n_"], often, 2 * edits + 1)
    other = pre.select("block", "p_", "i_", F.col("t").alias("y"), F.col("n_").alias("m_"))
    sized = F.least("n_", "m_") * (2 - r) + 1e-9 >= F.greatest("n_", "m_") * r
    by_gram = pre.withColumnRenamed("t", "x").join(other, ["block", "p_", "i_"]).where((F.col("x") < F.col("y")) & sized).select("block", "x", "y")

    met = by_word.select("*", F.lit(0).alias("g_")).unionByName(by_gram.select("*", F.lit(1).alias("g_"))).groupBy("block", "x", "y").agg(F.max("g_").alias("g_"))
    if candidates:
        return met.drop("g_")
    sides = met.join(t.select("block", F.col("t").alias("x"), F.col("w_").alias("wx_")), ["block", "x"]).join(t.select("block", F.col("t").alias("y"), F.col("w_").alias("wy_")), ["block", "y"])
    joined = lambda a: F.array_join(a, " ")
    both = F.array_sort(F.array_intersect("wx_", "wy_"))
    glued = lambda mine, theirs: joined(F.concat(both, F.array_sort(F.array_except(mine, theirs))))
    sides = sides.withColumns({"s_": joined(both), "sx_": glued("wx_", "wy_"), "sy_": glued("wy_", "wx_")})
    ls, lx, ly = F.length("s_"), F.length("sx_"), F.length("sy_")
    exact = F.when((ls > 0) & ((ls == lx) | (ls == ly)), 100.0).otherwise(F.greatest(*[F.when(ls > 0, 200.0 * ls / (ls + n)).otherwise(0.0) for n in (lx, ly)]))
    judged = sides.select("block", "x", "y", "g_", "sx_", "sy_", exact.alias("ratio"))
    sure = judged.where(F.col("ratio") == 100).select("block", "x", "y", "ratio")
    rest = judged.where((F.col("ratio") < 100) & ((F.col("ratio") >= ratio) | (F.col("g_") == 1))).withColumn("ratio", F.greatest("ratio", indel_ratio("sx_", "sy_"))).where(F.col("ratio") >= ratio)
    return sure.unionByName(rest.select("block", "x", "y", "ratio"))


def look_alikes(new: DataFrame, known: DataFrame, ratio: float = 87) -> DataFrame:
    """(x, y, ratio): names of new (t) and of known, different ones, whose Ratcliff-Obershelp ratio is `ratio` or more.

    Matching blocks are a common subsequence, so that ratio is never over the indel ratio: what near_between() lets by is
    judged exactly, and no pair is lost. The ratio is not symmetric; x is the first text.
    """
    one = F.lit("").alias("block")
    pairs = near_between(new.select(one, "t"), known.select(one, "t"), ratio).where("x <> y").select("x", "y")
    return pairs.withColumn("ratio", sequence_ratio("x", "y")).where(F.col("ratio") >= ratio)
