"""What inventory texts say: formats, colours, conditions, lengths, years, tags and kinds. Column expressions, all JVM side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .titles import let

# Shorthand of formats, by what it is about.
FORMATS = {
    "reissue": {"RE": "Reissue", "RP": "Repress", "RM": "Remastered"},
    "feature": {
        "Gat": "Gatefold", "Ltd": "Limited", "Num": "Numbered", "180": "180g", "200": "200g", "Emb": "Embossed", "Etch": "Etched", "S/Sided": "Single-sided", "RSD": "Record Store Day", "TP": "Test pressing",
        "Promo": "Promo", "Pic": "Picture disc", "Club": "Club edition", "Dlx": "Deluxe", "Box": "Box set", "Mono": "Mono", "Stereo": "Stereo", "Quad": "Quadraphonic",
    },
    "warn": {"Unofficial": "Unofficial"},
    "kind": {"Comp": "Compilation", "Album": "Album", "EP": "EP", "Single": "Single"},
    "colour": {
        "Red": "Red", "Blu": "Blue", "Yel": "Yellow", "Gre": "Green", "Ora": "Orange", "Pur": "Purple", "Whi": "White", "Bla": "Black", "Cle": "Clear", "Tra": "Transparent", "Gol": "Gold", "Sil": "Silver", "Pin": "Pink",
        "Ros": "Rose", "Bro": "Brown", "Gry": "Grey", "Mar": "Marbled", "Spl": "Splatter", "Vio": "Violet", "Tur": "Turquoise", "Smo": "Smoke", "Sun": "Sunburst", "Amb": "Amber", "Cry": "Clear",
    },
}
MEDIA = r"""(?i)^(\d+)?x?(LP|12"|10"|7"|Vinyl|Box Set|CD|Cass)$"""
# Names of colours looked for in free text; the last three are known by their shorthand alone.
COLOURS = "red blue yellow green orange purple violet white black clear transparent gold silver pink rose brown grey gray turquoise smoke bone cream magenta teal aqua beige maroon oxblood".split() + ["sea blue", "crimson", "amber"]
MIXED = ["marbled", "splatter", "sunburst"]
# Grades of a condition, the first whose words begin it, and their scores.
GRADES = (("mint", "M", 8), ("near mint", "NM", 7), ("very good plus", "VG+", 6), ("very good", "VG", 5), ("good plus", "G+", 4), ("good", "G", 3), ("fair", "F", 2), ("poor", "P", 1))
# How tags are written.
SMALL_WORDS = ("and", "of", "the", "n", "&")
ACRONYMS = {"r&b": "R&B", **{w: w.upper() for w in "edm idm ebm aor nwobhm uk us dj".split()}}
SYNONYMS = {"thrash": "thrash metal", "prog rock": "progressive rock", "nwobhm": "new wave of british heavy metal", "rock & roll": "rock and roll", "hardcore": "hardcore punk"}
# Words of a title that make it a compilation.
COMPILATION = r"(?i)\b(greatest hits|best of|the very best|anthology|essential|definitive|collection|singles)\b"


def parse_format(c: Column) -> Column:
    """struct(media, tags array<struct<code, label, kind>>, discs, reissue) of a text such as "2xLP, Album, RE + CD". Unknown shorthand: of kind other. Null: no media, one disc."""
    kinds = F.create_map(*[F.lit(x) for kind, of in FORMATS.items() for code in of for x in (code, kind)])
    labels = F.create_map(*[F.lit(x) for of in FORMATS.values() for code, label in of.items() for x in (code, label)])
    words = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\s*\+\s*|,"), lambda x: F.trim(x)), lambda x: x != "")

    def read(words: Column) -> Column:
        media = F.filter(words, lambda x: x.rlike(MEDIA))
        tags = F.transform(F.array_distinct(F.filter(words, lambda x: ~x.rlike(MEDIA))), lambda x: F.struct(x.alias("code"), F.coalesce(F.try_element_at(labels, x), x).alias("label"), F.coalesce(F.try_element_at(kinds, x), F.lit("other")).alias("kind")))
        number = lambda x: F.greatest(F.coalesce(F.regexp_extract(x, r"^(\d+)x", 1).try_cast("int"), F.lit(1)), F.lit(1))
        discs = F.aggregate(media, F.lit(0), lambda n, x: n + number(x), lambda n: F.greatest(n, F.lit(1)))
        return F.struct(F.nullif(F.array_join(media, " + "), F.lit("")).alias("media"), tags.alias("tags"), discs.alias("discs"), F.exists(tags, lambda t: t["kind"] == "reissue").alias("reissue"))

    return let(words, read)


def colours(tags: Column, text: Column) -> Column:
    """Colours that the tags name and, after them, those that a free text does."""
    named = F.transform(F.filter(tags, lambda t: t["kind"] == "colour"), lambda t: F.lower(t["label"]))
    said = F.filter(F.array(*[F.lit(x) for x in COLOURS]), lambda x: F.regexp_like(F.lower(F.coalesce(text, F.lit(""))), F.concat(F.lit(r"\b"), x, F.lit(r"\b"))))
    return F.filter(F.array_union(named, said), lambda x: x.isin(*COLOURS, *MIXED))


def grade(c: Column) -> Column:
    """struct(short, score) of a condition; anything else stands for itself with score 0, null and empty for null."""
    low = F.lower(c)
    short, score = F.when(low.rlike("generic|no cover|not graded"), F.lit("-")).otherwise(c), F.lit(0)
    for words, name, n in reversed(GRADES):
        short, score = F.when(low.startswith(words), F.lit(name)).otherwise(short), F.when(low.startswith(words), F.lit(n)).otherwise(score)
    return F.when(c != "", F.struct(short.alias("short"), score.alias("score")))


def length_text(ms: Column) -> Column:
    """Milliseconds as m:ss."""
    s = F.round(ms / 1000).cast("long")
    return F.concat(F.floor(s / 60).cast("string"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"))


def duration_text(ms: Column) -> Column:
    """Milliseconds as minutes under an hour, hours and minutes under ten, else hours."""
    minutes, hours = F.round(ms / 60000).cast("long"), F.floor(ms / 3600000).cast("long")
    rest = F.round((ms / 3600000 - hours) * 60).cast("long")
    return F.when(minutes < 60, F.concat(minutes.cast("string"), F.lit(" min"))).when(ms < 36000000, F.concat(hours.cast("string"), F.lit(" h "), rest.cast("string"), F.lit(" min"))).otherwise(F.concat(F.round(ms / 3600000).cast("long").cast("string"), F.lit(" h")))


def year_of(c: Column) -> Column:
    """The first four digits in a row of a text, as a number."""
    return F.nullif(F.regexp_extract(c, r"\d{4}", 0), F.lit("")).cast("int")


def decade(year: Column) -> Column:
    return F.when(year != 0, F.concat((F.floor(year / 10) * 10).cast("string"), F.lit("s")))


def pressing_years(kind: Column, pressed: Column, album: Column, marked: Column, gap: int = 2) -> Column:
    """struct(year, unconfirmed, reissue): the original year, unknown where a marked reissue's album year isn't earlier than its pressing; a reissue if it is marked as one or was pressed `gap` years later. kind, set by hand, wins over marked."""
    is_marked = F.when(kind.isNotNull(), kind != "original").otherwise(F.coalesce(marked, F.lit(False)))
    year = F.when(~(is_marked & F.coalesce(album >= pressed, F.lit(False))), album)
    late = kind.isNull() & F.coalesce(pressed >= year + gap, F.lit(False))
    return F.struct(year.alias("year"), (year.isNull() & album.isNotNull()).alias("unconfirmed"), (is_marked | late).alias("reissue"))


def tag_name(c: Column) -> Column:
    """A tag as it is stored: lower case, single spaces, synonyms under one name."""
    name = F.regexp_replace(F.trim(F.lower(F.regexp_replace(c, r"\s+", " "))), " +", " ")
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in SYNONYMS.items() for x in kv]), name), name)


def tag_title(c: Column) -> Column:
    """A tag as it is shown: capitals, but for small words after the first, at hyphens and slashes too; acronyms."""
    acronyms = F.create_map(*[F.lit(x) for kv in ACRONYMS.items() for x in kv])
    cap = lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substr(x, F.lit(2)))

    def shown(w: Column, i: Column) -> Column:
        parts = F.regexp_extract_all(w, F.lit(r"[-/]?[^-/]*"), F.lit(0))
        capped = F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[-/]"), F.concat(F.substring(p, 1, 1), cap(F.substr(p, F.lit(2))))).otherwise(cap(p))), "")
        return F.coalesce(F.try_element_at(acronyms, F.lower(w)), F.when((i > 0) & F.lower(w).isin(*SMALL_WORDS), F.lower(w)), capped)

    return F.array_join(F.transform(F.split(c, " "), shown), " ")


def release_kind(primary: Column, secondary: Column) -> Column:
    """single, compilation, live, album, ep or other, of a primary type and a list of secondary ones."""
    secondary = F.coalesce(secondary, F.array().cast("array<string>"))
    has = lambda x: F.array_contains(secondary, x)
    live = F.when(primary.isin("Album", "EP"), "live").otherwise("other")
    return F.when(primary == "Single", "single").when(has("Compilation"), "compilation").when(has("Live"), live).when(F.size(secondary) > 0, "other").when(primary == "Album", "album").when(primary == "EP", "ep").otherwise("other")


def type_conflict(title: Column, tags: Column, primary: Column, secondary: Column) -> Column:
    """Why a release of these types can't be the titled one, or null: remix, original, studio, live, compilation."""
    secondary = F.coalesce(secondary, F.array().cast("array<string>"))
    local, theirs = (lambda x: F.array_contains(tags, x)), (lambda x: F.array_contains(secondary, x))
    return (
        F.when(local("remix") & (primary == "Album") & ~theirs("Remix"), "original").when(~local("remix") & theirs("Remix"), "remix").when(local("live") & ~theirs("Live"), "studio")
        .when(~local("live") & theirs("Live"), "live").when(~title.rlike(COMPILATION) & theirs("Compilation"), "compilation")
    )


def clean_text(c: Column, boilerplate: tuple[str, ...] = (), shared: str | None = None) -> Column:
    """A text without tags, boilerplate patterns and blank lines, paragraphs apart by an empty line; null if nothing is left or if it says that several share the name (pattern `shared`)."""
    for p in (*boilerplate, r"<[^>]*>"):
        c = F.regexp_replace(c, p, "")
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(name), F.lit(sign))
    parts = F.filter(F.transform(F.split(c, r"\n"), lambda p: F.trim(F.regexp_replace(p, r"[ \t]+", " "))), lambda p: p != "")
    text = F.nullif(F.array_join(parts, "\n\n"), F.lit(""))
    return F.when(~text.rlike(shared), text) if shared else text


def format_text(formats: Column) -> Column:
    """The export's shorthand of array<struct<name, qty, descriptions>>: "2xLP, Album, RE + CD". Descriptions that are media stand for the name; known ones are shortened, others left."""
    short = F.create_map(*[F.lit(x) for of in FORMATS.values() for code, label in of.items() if code != "Cry" for x in (label, code)])

    def one(f: Column) -> Column:
        words = F.coalesce(f["descriptions"], F.array().cast("array<string>"))
        media = F.filter(words, lambda x: x.rlike(MEDIA))
        name = F.coalesce(F.get(media, F.lit(0)), f["name"])
        count = F.when(f["qty"] > 1, F.concat(f["qty"].cast("string"), F.lit("x"), name)).otherwise(name)
        rest = F.transform(F.filter(words, lambda x: ~x.rlike(MEDIA)), lambda x: F.coalesce(F.try_element_at(short, x), x))
        return F.array_join(F.concat(F.array(count), rest), ", ")

    return F.array_join(F.transform(formats, one), " + ")
