"""Enrichment: token counts, suggested canonical values, a hook for outside models."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from millrace.functions import text
from millrace.operators import profile as P
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def enrich(df: DataFrame, columns: list[str], few: int = 100) -> DataFrame:
    """{c}__token_count, and {c}__suggested_canonical (the mode, of equals the smallest) where distinct values are few."""
    modes = P.modes_lowest(P.stacked(df, columns, columns[0]).filter("value is not null"))
    counts = P.distinct_counts(df, columns).join(modes, "column", "left")
    known = {r["column"]: r for r in counts.collect()}
    out = {f"{c}__token_count": text.token_count(F.col(c)) for c in columns}
    out |= {f"{c}__suggested_canonical": F.lit(known[c]["mode"]) for c in columns if c in known and known[c]["n_distinct"] < few}
    return df.withColumns(out)


def analyse(df: DataFrame, model: Callable[[Iterator], Iterator] | None, schema: str | None = None) -> DataFrame:
    """Batches through an outside model, off without one; model maps pandas frames to frames of the schema."""
    return df if model is None else df.mapInPandas(model, schema or df.schema)
