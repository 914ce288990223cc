"""Calls in fixed windows, for tables and streams alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def calls_per_window(calls: DataFrame, limit: int = 100, size: str = "60 seconds", late: str | None = None) -> DataFrame:
    """(tenant, window_start, calls, over_limit). late: how long a stream waits for late calls."""
    if late is not None:
        calls = calls.withWatermark("ts", late)
    counted = calls.groupBy("tenant", F.window("ts", size).alias("w")).agg(F.count(F.lit(1)).alias("calls"))
    return counted.select("tenant", F.col("w.start").alias("window_start"), "calls", (F.col("calls") > limit).alias("over_limit"))


def calls_within(calls: DataFrame, seconds: int = 60) -> DataFrame:
    """The calls (tenant, ts, and more) with ``within``: how many calls the tenant made in so many seconds up to and with this one.

    Time is cut into stretches of that length; a call counts in its own stretch
    and is looked back at from the next one, so that a tenant with very many
    calls is spread over time and no task holds more than two of its stretches.
    """
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    width = seconds * 1_000_000
    marked = calls.withColumns({"_at": at, "_own": F.floor(at / width)})
    both = marked.withColumn("_part", F.explode(F.array("_own", F.col("_own") + 1)))
    window = Window.partitionBy("tenant", "_part").orderBy("_at").rangeBetween(-(width - 1), 0)
    return both.withColumn("within", F.count(F.lit(1)).over(window)).filter("_part = _own").drop("_at", "_own", "_part")


def refused(calls: DataFrame, limits: DataFrame, seconds: int = 60) -> DataFrame:
    """The calls that exceed their tenant's limit (tenant, limit) within a sliding window; tenants without one are let in."""
    return calls_within(calls, seconds).join(F.broadcast(limits) if _few(limits) else limits, "tenant").filter(F.col("within") > F.col("limit")).drop("limit")


def _few(rows: DataFrame, most: int = 100_000) -> bool:
    return rows.limit(most + 1).count() <= most
