"""Cleaning of rows as they arrive."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd

from millrace.functions import hashing
from millrace.operators import clean
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def first_of_each(rows: DataFrame, key: Column, time: str | None = None, within: str = "1 day") -> DataFrame:
    """One row of each key. With an event time, a key is remembered only so long, and state stays bounded."""
    keyed = rows.withColumn("row_hash", key)
    if time is None:
        return keyed.dropDuplicates(["row_hash"])
    return keyed.withWatermark(time, within).dropDuplicatesWithinWatermark(["row_hash"])


def first_in_order(rows: DataFrame, key: Column, order: str, time: str | None = None, within: str = "1 day") -> DataFrame:
    """(row_hash, row_number, replaces): the row of each key with the smallest number, whatever the order in which rows arrive.

    A key is told once, with the smallest number of its first batch (replaces is
    null), and once more whenever a later batch brings a smaller one (replaces is
    the number told before). With an event time, a key is forgotten once all
    later rows are so much younger than its last one, and state stays bounded.
    Numbers are whole; rows without one are let go.
    """

    def least(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now, latest = None, 0
        for f in frames:
            now = min(int(f["row_number"].min()), int(f["row_number"].min()) if now is None else now)
            latest = max(latest, int(f["ms"].max()))
        before = state.get[0] if state.exists else None
        if before is None or now < before:
            state.update((now,))
            yield pd.DataFrame({"row_hash": [key[0]], "row_number": [now], "replaces": pd.array([before], "Int64")})
        if time is not None:
            state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs()) + 1)

    if time is not None:
        rows = rows.withWatermark(time, within)
    stamp = F.lit(0).cast("long") if time is None else F.unix_millis(F.col(time).cast("timestamp"))
    numbered = rows.select(key.alias("row_hash"), F.col(order).cast("long").alias("row_number"), *([time] if time else []), stamp.alias("ms")).filter("row_number is not null")
    timeout = GroupStateTimeout.NoTimeout if time is None else GroupStateTimeout.EventTimeTimeout
    return numbered.groupBy("row_hash").applyInPandasWithState(least, "row_hash string, row_number long, replaces long", "number long", "append", timeout)


def clean_with(rows: DataFrame, stats: dict[str, dict], path: str, checkpoint: str, exclude: tuple[str, ...] = ("id",)) -> DataStreamWriter:
    """A writer that cleans every micro-batch with statistics frozen before and appends it to a Parquet folder.

    A batch is written under its number, so a batch that is run again replaces itself.
    """

    def put(batch: DataFrame, number: int) -> None:
        clean.impute(batch, stats).withColumn("row_hash", hashing.content_hash(batch, exclude)).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(put)
