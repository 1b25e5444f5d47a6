"""Titles whose parts are known."""

import pytest

from annalist.functions import text, titles

TITLES = {
    "Motörhead": ("Motörhead", [], "motorhead", None),
    "Carolus Rex - English Version": ("Carolus Rex", ["lang-english"], "carolus rex", None),
    "Łódź (Live at the Ærø) [2009 Remastered]": ("Łódź", ["edition", "live"], "łodz", None),
    "Song (Original Mix)": ("Song", ["edition"], "song", None),
    "Song (2015 Mix) - Demo": ("Song", ["demo", "remix"], "song", None),
    "Song (Original Mix) (Hot Chip Remix)": ("Song", ["edition", "remix"], "song", None),
    "Part One (of two)": ("Part One (of two)", [], "part one of two", None),
    "Live Wire": ("Live Wire", [], "live wire", None),
    "Van Halen II": ("Van Halen II", [], "van halen ii", "2"),
    "Vol. 04 - Deluxe": ("Vol. 04", ["edition"], "vol 04", "4"),
    "X": ("X", [], "x", None),
    "(Live)": ("(Live)", [], "live", None),
    "A - B - 1999": ("A - B", ["edition"], "a b", None),
    "Straße & ﬀ Řeka ΣΊΣΥΦΟΣ": ("Straße & ﬀ Řeka ΣΊΣΥΦΟΣ", [], "strasse and ﬀ reka σισυφοσ", None),
    "Song (live) (demo) (remix) (edit) (acoustic) (instrumental) (session)": ("Song", ["acoustic", "demo", "edit", "instrumental", "live", "remix", "session"], "song", None),
    "": ("", [], "", None),
    None: ("", [], "", None),
}


def test_title_keys(spark):
    df = titles.title_keys(spark.createDataFrame([(t,) for t in TITLES], "title string"), "title")
    assert {r.title: (r.base, r.tags, r.key, r.sequel) for r in df.collect()} == TITLES


@pytest.mark.parametrize(("a", "want"), [("Tomorrow’s Dream - Live", "tomorrows dream#live"), ("95 - N.A.S.T.Y.", "95 n a s t y"), ("Rex (Swedish Version) [Live]", "rex#lang-swedish"), ("Song (Original Mix)", "song")])
def test_page_key(spark, a, want):
    assert spark.range(1).select(titles.page_key(titles.F.lit(a)).alias("k")).first().k == want


def test_compact(spark):
    got = spark.createDataFrame([("Motörhead",), ("Łódź 2,000",), ("A_B - c",)], "t string").select(text.compact(titles.F.col("t")).alias("k")).collect()
    assert [r.k for r in got] == ["motorhead", "łodz2000", "abc"]
