"""Cleaning: imputation, outliers, text, category merging. Statistics come in as values; no operator runs a job on its own
but outlier_flags without bounds and merge_categories."""

from __future__ import annotations

from difflib import get_close_matches

from millrace.functions import numeric, quality, text
from millrace.operators import profile as P
from millrace.operators.shape import stacked
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Categories are merged in columns with 2 to this many distinct values.
CATEGORIES = 500


_WHOLE = ("tinyint", "smallint", "int", "bigint")


def fills(df: DataFrame, stats: dict[str, dict], order: tuple[str, ...] = ("median", "mode"), empty_is_missing: bool = False) -> tuple[dict[str, Column], dict[str, Column]]:
    """The filled cells and the flags of the columns that have statistics.

    A column of whole numbers whose fill is a fraction becomes one of doubles.
    """
    kinds, cells, flags = dict(df.dtypes), {}, {}
    for c in df.columns:
        known = stats.get(c)
        if known is None:
            continue
        cell, kind = F.col(f"`{c}`"), kinds[c]
        gone = quality.missing(cell, kind, empty_is_missing)
        values = [known[s] for s in order if known.get(s) is not None]
        if kind in _WHOLE and values and _fraction(values[0]):
            cell, kind = cell.cast("double"), "double"
        fill = F.coalesce(*[F.lit(v).try_cast(kind) for v in values]) if values else F.lit(None).cast(kind)
        cells[c] = F.when(gone, fill).otherwise(cell)
        flags[c] = gone & (fill.isNotNull() if values else F.lit(False))
    return cells, flags


def _fraction(value) -> bool:
    try:
        return not float(value).is_integer()
    except (TypeError, ValueError, OverflowError):
        return False


def impute(df: DataFrame, stats: dict[str, dict], order: tuple[str, ...] = ("median", "mode"), flags: bool = True, empty_is_missing: bool = False) -> DataFrame:
    """Missing cells filled with the first known statistic in order; {c}_was_imputed tells where.

    A median applies to numeric columns only. The reference order of the row
    cleaner is ("mode", "median") with empty texts missing too.
    """
    cells, told = fills(df, stats, order, empty_is_missing)
    out = [cells.get(c, F.col(f"`{c}`")).alias(c) for c in df.columns]
    return df.select(*out, *[v.alias(f"{c}_was_imputed") for c, v in told.items() if flags])


def outlier_bounds(quartiles: DataFrame, reach: float = 1.5) -> dict[str, tuple[float, float]]:
    """(low, high) of each column with a spread."""
    return {r["column"]: (r["q1"] - reach * r["iqr"], r["q3"] + reach * r["iqr"]) for r in quartiles.collect() if r["iqr"]}


def outlier_flags(df: DataFrame, columns: list[str], bounds: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """{c}_is_outlier for each column; false for nulls and for columns without a spread."""
    bounds = outlier_bounds(P.quartiles(df, columns)) if bounds is None else bounds
    return df.select("*", *[(F.coalesce(~F.col(f"`{c}`").between(*bounds[c]), F.lit(False)) if c in bounds else F.lit(False)).alias(f"{c}_is_outlier") for c in columns])


def drop_outliers(flagged: DataFrame) -> DataFrame:
    """Rows without any outlier flag."""
    for c in [c for c in flagged.columns if c.endswith("_is_outlier")]:
        flagged = flagged.filter(~F.col(f"`{c}`"))
    return flagged


def strip_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: text.strip(F.col(f"`{c}`").cast("string")) for c in columns})


def lower_columns(df: DataFrame, columns: list[str], keep_punctuation: bool = True) -> DataFrame:
    return df.withColumns({c: text.lower_text(F.col(f"`{c}`"), keep_punctuation) for c in columns})


def alias_map(values: list[str], cutoff: float = 0.86, n: int = 10) -> dict[str, str]:
    """Leader clustering in the given order: each value not yet claimed leads the values close to it."""
    aliases: dict[str, str] = {}
    for leader in values:
        if leader not in aliases:
            aliases |= {v: leader for v in get_close_matches(leader, values, n=n, cutoff=cutoff)}
    return aliases


def category_aliases(df: DataFrame, columns: list[str], row_id: str, cutoff: float = 0.86) -> dict[str, dict[str, str]]:
    """The alias map of each column with 2 to CATEGORIES distinct values, in order of first sight.

    One job for all columns; of each, CATEGORIES + 1 values at most leave a task.
    """
    if not columns:
        return {}
    firsts = stacked(df, columns, row_id).filter("value is not null").groupBy("column", "value").agg(F.min("row_id").alias("seen"))
    order = Window.partitionBy("column").orderBy("seen", "value")
    few = firsts.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= CATEGORIES + 1)
    values: dict[str, list[str]] = {}
    for r in sorted(few.collect(), key=lambda r: r["_r"]):
        values.setdefault(r["column"], []).append(r["value"])
    return {c: alias_map(v, cutoff) for c, v in values.items() if 2 <= len(v) <= CATEGORIES}


def merge_categories(df: DataFrame, columns: list[str], row_id: str, cutoff: float = 0.86) -> DataFrame:
    """Values replaced by the leaders of their clusters."""
    aliases = category_aliases(df, columns, row_id, cutoff)
    return df.withColumns({c: text.canonical(F.col(f"`{c}`"), own) for c, own in aliases.items()})


def row_cells(df: DataFrame, stats: dict[str, dict], skip: tuple[str, ...] = ()) -> dict[str, Column]:
    """The row cleaner as expressions: fill missing cells by mode, then median; clean texts; numbers finite or null."""
    cells, _ = fills(df, stats, ("mode", "median"), empty_is_missing=True)
    out = {}
    for c, kind in df.dtypes:
        cell = cells.get(c, F.col(f"`{c}`"))
        if c not in skip and kind == "string":
            cell = text.clean_text(cell)
        elif c not in skip and kind in ("double", "float"):
            cell = numeric.finite(cell)
        out[c] = cell
    return out


def clean_rows(df: DataFrame, stats: dict[str, dict], skip: tuple[str, ...] = ()) -> DataFrame:
    """The rows cleaned by row_cells."""
    return df.select(*[cell.alias(c) for c, cell in row_cells(df, stats, skip).items()])
