"""Cell and row quality: missing values, changes, confidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def missing(c: Column, kind: str = "string", empty_is_missing: bool = True) -> Column:
    """Null, NaN in a floating column, and the empty text if asked."""
    out = c.isNull()
    if kind in ("double", "float"):
        out = out | F.isnan(c)
    if kind == "string" and empty_is_missing:
        out = out | (c == "")
    return out


def change_kind(before: Column, after: Column) -> Column:
    """imputation, normalization or other for a changed cell; null for an equal one."""
    text = ~before.cast("string").eqNullSafe(after.cast("string"))
    return F.when(before.eqNullSafe(after), F.lit(None)).when(before.isNull(), "imputation").when(text, "normalization").otherwise("other")


def confidence(imputed: Column, near_duplicate: Column, exact_duplicate: Column | None = None) -> Column:
    """1, less 10 % for any imputation and 15 % for a near duplicate, 0.5 at least; 0 for an exact duplicate."""
    score = F.when(imputed, 0.9).otherwise(1.0) * F.when(near_duplicate, 0.85).otherwise(1.0)
    score = F.greatest(F.lit(0.5), score)
    return score if exact_duplicate is None else F.when(exact_duplicate, 0.0).otherwise(score)
