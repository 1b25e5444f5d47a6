"""Titles: what belongs to the title itself and what says which version or edition it is. Column expressions, all JVM side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import compact, fold

# Words of a suffix that name a version, by the tag they give.
VARIANTS = {
    "live": r"live|in concert",
    "demo": r"demos?|rehearsal|outtakes?|early|pre.?production",
    "remix": r"re-?mix(ed)?|mix(ed)?|rmx|dub|vip",
    "edit": r"edit|extended",
    "rerecording": r"re-?record(ed|ing)?|taylor.s version",
    "acoustic": r"acoustic|unplugged",
    "instrumental": r"instrumental|karaoke",
    "session": r"sessions?|take|spotify singles",
    "version": r"version",
}
# Words of a suffix that name an issue of the same recording; the stem of "remastered" may go on.
EDITION = r"\bre-?master|\b(deluxe|expanded|anniversary|edition|reissue|mono|stereo|bonus|explicit|clean|feat|ft|featuring|digital(ly)?|soundtrack|motion picture|hidden track)\b|\b(single|album|lp|original|us|uk)\s+(version|mix)\b|^\d{4}$"
ISSUE_MIX = r"\b(mono|stereo|single|album|lp|original|us|uk)\s+mix\b"
NEW_MIX = r"\bre-?mix(ed)?\b|\brmx\b|\bdub\b|\bvip\b"
# Languages that a version may be named by.
LANGUAGES = ["english", "swedish", "german", "french", "spanish", "italian", "portuguese", "japanese", "finnish", "norwegian", "danish", "dutch", "polish", "russian", "hungarian", "czech", "latin", "korean", "chinese"]
# Numerals of sequels.
ROMAN = {"i": 1, "ii": 2, "iii": 3, "iv": 4, "v": 5, "vi": 6, "vii": 7, "viii": 8, "ix": 9, "x": 10}
# Kinds of lines that are no items, the first that fits.
NO_ITEM = {
    "medley": r"\bmedley\b|\s/\s",
    "solo": r"\bsolo\b",
    "jam": r"\bjam\b|\bimprov|\bdoodle|\bnoodl|\bad[ -]?lib",
    "intro": r"\b(intro|outro|tape|interlude|prelude)\b",
    "snippet": r"\b(tease|snippet|reprise)\b",
    "speech": r"\b(speech|introduction)\b",
}
_APOSTROPHES = "['’`´]"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once and the expression no longer for it."""
    return F.transform(F.array(value), use)[0]


def suffix_tags(suffix: Column) -> Column:
    """Tags of one suffix, or null if nothing in it is known."""
    low = F.lower(suffix)
    language = F.regexp_extract(low, rf"^\s*({'|'.join(LANGUAGES)})(\s+(version|language|lyrics?|vocals?|edition))?\s*$", 1)
    issue_mix = low.rlike(ISSUE_MIX) & ~low.rlike(NEW_MIX)
    edition = low.rlike(EDITION)
    drop = {"remix": issue_mix, "version": edition}
    named = [F.when(low.rlike(rf"\b({words})\b") & ~drop.get(tag, F.lit(False)), F.lit(tag)) for tag, words in VARIANTS.items()]
    tags = F.array_compact(F.array(*named, F.when(edition, F.lit("edition"))))
    return F.when(language != "", F.array(F.concat(F.lit("lang-"), language))).when(F.size(tags) > 0, tags)


def split_title(title: Column) -> Column:
    """struct(base, tags): the title as written without the known suffixes at its end, in brackets or after " - ", and their tags, sorted. An unknown suffix ends it. Null: empty."""
    none = F.array().cast("array<string>")
    title = F.trim(F.coalesce(title, F.lit("")))
    rounds = F.size(F.split(title, r" - |[(\[]"))
    start = F.struct(title.alias("base"), none.alias("tags"))

    def peel(acc: Column, _: Column) -> Column:
        base = acc["base"]
        bracket, dash = r"(?s)^(.+?)\s*[(\[]([^()\[\]]*)[)\]]\s*$", r"(?s)^(.+) - (.*)$"
        known = lambda p: F.when(base.rlike(p), suffix_tags(F.regexp_extract(base, p, 2)))
        found = F.struct(known(bracket).alias("b"), known(dash).alias("d"))

        def cut(x: Column) -> Column:
            rest = F.when(x["b"].isNotNull(), F.regexp_extract(base, bracket, 1)).when(x["d"].isNotNull(), F.regexp_extract(base, dash, 1)).otherwise(base)
            return F.struct(F.rtrim(rest).alias("base"), F.array_union(acc["tags"], F.coalesce(x["b"], x["d"], none)).alias("tags"))

        return let(found, cut)

    return F.aggregate(F.sequence(F.lit(1), rounds), start, peel, lambda x: F.struct(x["base"].alias("base"), F.array_sort(x["tags"]).alias("tags")))


def sequel_marker(key: Column) -> Column:
    """The number at the end of a folded title, up to 99, or the Roman numeral of a title of several words; else null."""
    last = F.element_at(F.split(key, " "), -1)
    roman = F.try_element_at(F.create_map(*[F.lit(x) for r, n in ROMAN.items() for x in (r, str(n))]), last)
    return F.when(last.rlike("^[0-9]{1,2}$"), last.cast("int").cast("string")).when(key.contains(" "), roman)


def title_keys(df: DataFrame, title: str) -> DataFrame:
    """Add base, tags, variants (tags but for edition), key (the folded base), track_key (blind to apostrophes), compact (blind to spacing too) and sequel."""
    df = df.withColumn("split_", split_title(F.col(title))).withColumns({"base": F.col("split_.base"), "tags": F.col("split_.tags")}).drop("split_")
    df = df.withColumns({"variants": F.array_remove("tags", "edition"), "key": fold(F.col("base")), "track_key": fold(F.regexp_replace("base", _APOSTROPHES, ""))})
    return df.withColumns({"compact": F.regexp_replace("track_key", "[ _]+", ""), "sequel": sequel_marker(F.col("key"))})


def no_item_kind(title: Column) -> Column:
    """What a line that is no item is, or null."""
    return F.coalesce(*[F.when(F.lower(title).rlike(p), F.lit(kind)) for kind, p in NO_ITEM.items()])


def comparison_words(key: Column) -> Column:
    """Words of a folded title to compare: Nordic letters as Latin ones, n as and, Roman numerals as digits."""
    key = F.translate(key, "øđłð", "odld")
    for a, b in (("æ", "ae"), ("œ", "oe"), ("ß", "ss"), ("þ", "th")):
        key = F.replace(key, F.lit(a), F.lit(b))
    same = F.create_map(*[F.lit(x) for a, b in {"n": "and", **ROMAN}.items() for x in (a, str(b))])
    return F.transform(F.filter(F.split(key, " "), lambda w: w != ""), lambda w: F.coalesce(F.try_element_at(same, w), w))


def differing_words(a: Column, b: Column) -> Column:
    """struct(a, b): words left of two lists once those they share at the start and at the end are set aside."""
    shared = lambda x, y, most: F.size(F.filter(F.sequence(F.lit(0), most), lambda i: (i > 0) & (F.slice(x, F.lit(1), i) == F.slice(y, F.lit(1), i))))
    least = F.least(F.size(a), F.size(b))
    head = shared(a, b, least)
    tail = let(head, lambda h: shared(F.reverse(a), F.reverse(b), least - h))
    part = lambda x, h, t: F.slice(x, h + 1, F.size(x) - h - t)
    return let(F.struct(head.alias("h"), tail.alias("t")), lambda n: F.struct(part(a, n["h"], n["t"]).alias("a"), part(b, n["h"], n["t"]).alias("b")))


def page_key(title: Column) -> Column:
    """The key that pages group recordings by: without bracketed text and edition notes after " - ", blind to apostrophes; with #variant where the suffixes name one."""
    # Notes of an edition after a dash, and what makes a variant (the language tail and the four kinds below).
    edition = r"(?i)\s+-\s+(?=.*\b(remaster(ed)?|live|version|mix|edit|demo|mono|stereo|single|bonus|edition|re-?record(ing)?|session|take|acoustic|instrumental|\d{4})\b).*$"
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(title, r"\s*[(\[].*?[)\]]", ""), edition, ""), _APOSTROPHES, "")
    tails = F.concat(F.regexp_extract_all(title, F.lit(r"[(\[]([^)\]]*)[)\]]"), F.lit(1)), F.when(title.rlike("^.+? - "), F.array(F.regexp_extract(title, "^.+? - (.*)$", 1))).otherwise(F.array().cast("array<string>")))
    language = F.filter(F.transform(tails, lambda x: F.regexp_extract(F.lower(F.trim(x)), rf"^({'|'.join(LANGUAGES)})(\s+(version|language|lyrics?|vocals?|edition))?$", 1)), lambda x: x != "")
    tail = F.lower(F.array_join(tails, " "))
    variant = (
        F.when(F.size(language) > 0, F.concat(F.lit("lang-"), language[0])).when(tail.rlike(r"\b(live|unplugged)\b"), "live").when(tail.rlike(r"\b(remix|mix)\b") & ~tail.rlike(r"\boriginal mix\b"), "remix")
        .when(tail.rlike(r"\bdemo\b"), "demo").when(tail.rlike(r"\bacoustic\b"), "acoustic").when(tail.rlike(r"\binstrumental\b"), "instrumental")
    )
    return F.concat(F.regexp_replace(fold(plain), "_+", " "), F.coalesce(F.concat(F.lit("#"), variant), F.lit("")))


def contains_title(a: Column, b: Column, letters: int = 5) -> Column:
    """Whether all words of one folded title, articles aside, stand in order within the longer other; titles of few letters never do."""
    words = lambda c: F.filter(F.split(c, " "), lambda w: ~w.isin("", "the", "a", "an"))
    both = F.struct(words(a).alias("a"), words(b).alias("b"))

    def test(x: Column) -> Column:
        short = F.when(F.size(x["a"]) <= F.size(x["b"]), x["a"]).otherwise(x["b"])
        long_ = F.when(F.size(x["a"]) <= F.size(x["b"]), x["b"]).otherwise(x["a"])
        spaced = lambda y: F.concat(F.lit(" "), F.array_join(y, " "), F.lit(" "))
        return (F.size(short) < F.size(long_)) & (F.length(F.array_join(short, "")) >= letters) & spaced(long_).contains(spaced(short))

    return let(both, test)


__all__ = ["compact", "comparison_words", "contains_title", "differing_words", "fold", "let", "no_item_kind", "page_key", "sequel_marker", "split_title", "suffix_tags", "title_keys"]
