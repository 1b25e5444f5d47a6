"""Column expressions for names and titles. All JVM side."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _plain() -> tuple[str, str]:
    """Letters and digits that Unicode takes apart into one plain character and marks, and those characters."""
    pairs = []
    for code in range(0xC0, 0x10000):
        c = chr(code)
        parts = [x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)]
        if len(parts) == 1 and parts[0] != c and (c.isalnum() or parts[0].isalnum()):
            pairs.append((c, parts[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


MARKED, PLAIN = _plain()


def fold(c: Column) -> Column:
    """Lower case, no accents in any script, '&' as 'and', 'ß' as 'ss', anything but letters, digits and underscores as one space."""
    c = F.regexp_replace(F.translate(c, MARKED, PLAIN), r"\p{M}+", "")
    c = F.replace(F.replace(F.translate(F.lower(c), "ς", "σ"), F.lit("ß"), F.lit("ss")), F.lit("&"), F.lit(" and "))
    return F.trim(F.regexp_replace(c, r"[^\p{L}\p{N}_]+", " "))


def name_key(c: Column) -> Column:
    """A name without a leading or trailing 'the'."""
    return F.regexp_replace(F.regexp_replace(fold(c), "^the ", ""), " the$", "")


def article_key(c: Column) -> Column:
    """The key for A-Z lists: without a leading 'The'."""
    return F.regexp_replace(F.trim(c), r"(?i)^the\s+", "")


def letter(c: Column) -> Column:
    """A-Z, or # for anything else."""
    first = F.upper(F.substring(article_key(c), 1, 1))
    return F.when(first.rlike("^[A-Z]$"), first).otherwise("#")


def compact(c: Column) -> Column:
    """A key blind to spacing and punctuation, but not to letters of any script."""
    return F.regexp_replace(fold(c), "[ _]+", "")


def seconds(c: Column) -> Column:
    """Seconds of "m:ss" or "h:mm:ss"; null for anything else."""
    parts = F.transform(F.split(c, ":"), lambda x: x.cast("long"))
    return F.when(c.rlike(r"^\d+(:\d\d){1,2}$"), F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a * 60 + x))


def credits(c: Column) -> Column:
    """Credited names, without "(2)" suffixes and blanks."""
    return F.filter(F.transform(F.split(c, ","), lambda x: F.trim(F.regexp_replace(x, r"\s*\(\d+\)", ""))), lambda x: x != "")


def similarity(a: Column, b: Column) -> Column:
    """Levenshtein similarity, 0 to 1."""
    n = F.greatest(F.length(a), F.length(b))
    return F.when(n == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / n)


def signature(items: Column) -> Column:
    """Sixteen characters that stand for a set of keys, whatever its order."""
    return F.substring(F.sha1(F.array_join(F.array_sort(items), "\n")), 1, 16)
