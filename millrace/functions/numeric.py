"""Numbers in text, and numbers that are none."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What both engines read as a decimal number; Spark's cast alone would also take "1.0d".
FLOAT = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"


def parse(text: Column) -> Column:
    """The number that a text spells, null for any other text."""
    return F.when(text.rlike(FLOAT), text.try_cast("double"))


def numeric_like(c: Column) -> Column:
    """Whether a value reads as a number: not null, not blank, not a spelt null."""
    text = F.trim(c.cast("string"))
    return F.coalesce(text.rlike(FLOAT) | F.lower(text).isin("inf", "-inf", "+inf", "infinity", "-infinity", "+infinity"), F.lit(False))


def looks_numeric(c: Column) -> Column:
    """Like numeric_like, once thousands, currency, percent and brackets are gone."""
    return F.coalesce(F.regexp_replace(c.cast("string"), r"[,$€£%() ]", "").rlike(FLOAT), F.lit(False))


def parse_enhanced(c: Column) -> Column:
    """The number of a decorated text: one percent sign off, brackets for minus, commas off."""
    text = F.regexp_replace(F.trim(c.cast("string")), r"%$", "")
    text = F.replace(F.replace(text, F.lit("("), F.lit("-")), F.lit(")"), F.lit(""))
    text = F.replace(F.regexp_replace(text, r"[^0-9eE+\-.,]", ""), F.lit(","), F.lit(""))
    return parse(text)


def finite(c: Column) -> Column:
    """Null for NaN and both infinities."""
    return F.when(~(F.isnan(c) | (F.abs(c) == float("inf"))), c)
