"""Scalar text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that is trimmed and split at; the same set in every engine.
BLANK = "[ \\t\\r\\n]"


def strip(c: Column) -> Column:
    """Without white space at the ends."""
    return F.regexp_replace(c, f"^{BLANK}+|{BLANK}+$", "")


def tokens(c: Column) -> Column:
    """Whitespace tokens; a null text has none."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), f"{BLANK}+"), lambda t: t != "")


def token_count(c: Column) -> Column:
    return F.size(tokens(c))


def hash_id(prefix: str, c: Column) -> Column:
    """prefix + md5 of the UTF-8 text."""
    return F.concat(F.lit(prefix), F.md5(c))


def clean(c: Column, ascii_only: bool = True) -> Column:
    """Entities resolved, control characters dropped, other marks to spaces, lower case, trimmed.

    ascii_only also blanks letters outside ASCII.
    """
    for name, mark in (("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        c = F.replace(c, F.lit(name), F.lit(mark))
    keep = "[^A-Za-z0-9 ]" if ascii_only else "[^\\p{L}\\p{N} ]"
    return strip(F.lower(F.regexp_replace(F.regexp_replace(c, "[\\x00-\\x1f\\x7f-\\x9f]", ""), keep, " ")))


def normal_answer(c: Column) -> Column:
    """Lower case, no ASCII punctuation, no articles, single spaces."""
    bare = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[!-/:-@\\[-`{-~]", "")
    return F.array_join(F.filter(F.split(bare, f"{BLANK}+"), lambda w: ~w.isin("", "a", "an", "the")), " ")


def split_markers(c: Column, markers: list[str]) -> Column:
    """Parts between any of the markers, trimmed, blanks dropped."""
    import re

    parts = F.split(c, "|".join(re.escape(m) for m in markers))
    return F.filter(F.transform(parts, strip), lambda p: p != "")


def number_or(c: Column, default: float) -> Column:
    """The text as a number, else the default."""
    return F.coalesce(F.when(strip(c).rlike("^[-+]?[0-9]*\\.?[0-9]+$"), strip(c).try_cast("double")), F.lit(default))


def sorted_join(c: Column, separator: str = "<SEP>") -> Column:
    """Distinct values of an array, sorted and packed into one text."""
    return F.array_join(F.array_sort(F.array_distinct(c)), separator)
