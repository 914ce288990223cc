"""Sizes that are checked before anything is broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows up to which a side of few short columns is broadcast.
SMALL = 200_000


def small(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it has at most SMALL rows; joined by shuffle beyond. It is counted, so cut it before."""
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


#: Rows and bytes up to which ``light`` lets a side be broadcast.
ROWS, BYTES = 100_000, 16 << 20


def light(df: DataFrame) -> bool:
    """Whether df may be broadcast: at most ROWS rows, and BYTES bytes with eight for each column that isn't text. It is read, so cut it before."""
    width = [F.coalesce(F.octet_length(f"`{c}`"), F.lit(0)) if kind in ("string", "binary") else F.lit(8) for c, kind in df.dtypes]
    row = df.limit(ROWS + 1).agg(F.count(F.lit(1)).alias("n"), F.sum(sum(width, F.lit(8))).alias("b")).first()
    return row["n"] <= ROWS and (row["b"] or 0) <= BYTES
