"""Text columns: trimming, case, punctuation, tokens, snippets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: What a regular expression's \\s stands for.
SPACES = " \t\n\x0b\f\r"


def strip(c: Column) -> Column:
    """Without white space at both ends, in linear time (trim() would take spaces only)."""
    return F.btrim(c, F.lit(SPACES))


def lower_text(c: Column, keep_punctuation: bool = True) -> Column:
    """Lower case, without punctuation if asked; letters of any script are no punctuation."""
    low = F.lower(c)
    return low if keep_punctuation else F.regexp_replace(low, r"(?U)[^\w\s]", "")


def clean_text(c: Column) -> Column:
    """Lower case, one space between words, no signs at the ends."""
    one_space = F.regexp_replace(strip(F.lower(c)), r"\s+", " ")
    return F.regexp_replace(one_space, r"(?U)^\W++|(?<!\W)\W++$", "")  # a run is tried once, at its start


def token_count(c: Column) -> Column:
    """Words between white space; 0 for null."""
    return F.when(c.isNull(), 0).otherwise(F.size(F.regexp_extract_all(c, F.lit(r"(\S+)"), F.lit(1)))).cast("long")


def as_text(c: Column, null: str = "nan") -> Column:
    return F.coalesce(c.cast("string"), F.lit(null))


def snippet(columns: list[Column], null: str = "nan") -> Column:
    """The first three columns as text, a space between."""
    return F.concat_ws(" ", *[as_text(c, null) for c in columns[:3]])


def canonical(c: Column, aliases: dict[str, str]) -> Column:
    """aliases.get(c, c) for a bounded map."""
    if not aliases:
        return c
    pairs = [F.lit(x) for kv in sorted(aliases.items()) for x in kv]
    return F.coalesce(F.create_map(*pairs)[c], c)
