"""Ratios of two texts, 0 to 100. The Levenshtein ratio is Spark's own; the others need a table of both texts' characters and run as Arrow functions, meant for pairs that a prefilter left."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence: one bit a character of a, in one number that each character of b updates."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    all_ = (1 << len(a)) - 1
    row = all_
    for c in b:
        met = row & places.get(c, 0)
        row = (row + met | row - met) & all_
    return len(a) - row.bit_count()


def indel(a: str, b: str) -> float:
    """Share of characters that stay when one text becomes the other by insertions and deletions."""
    return 200.0 * common_length(a, b) / (len(a) + len(b)) if a or b else 100.0


def token_set(a: str, b: str) -> float:
    """Best indel ratio among the words both have and those with what either has besides; 100 if one's words are all the other's."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, mine, theirs = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    if both and (not mine or not theirs):
        return 100.0
    first, second = (f"{both} {s}".strip() for s in (mine, theirs))
    return max(indel(first, second), *((indel(both, first), indel(both, second)) if both else (0.0,)))


def token_sort(a: str, b: str) -> float:
    return indel(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def sequence(a: str, b: str) -> float:
    """Twice the length of matching blocks, longest first, in the length of both."""
    return 100.0 * SequenceMatcher(None, a, b, autojunk=False).ratio()


def _column(f):
    @F.pandas_udf(DoubleType())
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else f(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    return ratio


indel_ratio, token_set_ratio, token_sort_ratio, sequence_ratio = (_column(f) for f in (indel, token_set, token_sort, sequence))
