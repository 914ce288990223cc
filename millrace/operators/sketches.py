"""Profiles that merge: a state of bounded size for each column, kept by file or job and merged when it is read.

The state of a column is its number of rows and values, a HyperLogLog sketch of
its distinct values, a KLL sketch of its ranks if it holds numbers, and its most
frequent values with their counts. States of any parts of a table merge into
that of the whole, within the same bounds: distinct values to about 1.04 /
sqrt(2**LG) of themselves (exact for some hundreds), quantiles to ``rank_error``
of the ranks (exact up to as many values as the accuracy), and counts of frequent
values exactly while a column has no more than three quarters of ITEMS distinct
ones, else from below.

Defined cases: null and NaN are no values; a column without values has no
quantiles and no mode; an empty table has states of nothing, which merge too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

#: Accuracy of the ranks, bits of the distinct sketch, and values whose counts are tracked.
ACCURACY, LG, ITEMS = 4096, 14, 4096
NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


def rank_error(accuracy: int = ACCURACY) -> float:
    """How far the rank of a quantile may be off, as a share of all values, at odds of 99 in 100 (the KLL sketch's published fit)."""
    return 2.296 / accuracy**0.9021


def state(df: DataFrame, columns: list[str], accuracy: int = ACCURACY) -> DataFrame:
    """A row for each column: its state. One pass; tasks send one sketch of each kind a column."""
    kinds = dict(df.dtypes)

    def of(c: str) -> Column:
        cell, numeric = F.col(f"`{c}`"), kinds[c].split("(")[0] in NUMBERS
        if kinds[c] in ("float", "double"):
            cell = F.nanvl(cell, F.lit(None).cast(kinds[c]))
        ranks = F.kll_sketch_agg_double(cell.cast("double"), accuracy) if numeric else F.lit(None).cast("binary")
        common = F.call_function("approx_top_k_accumulate", cell.cast("string"), F.lit(ITEMS))
        return F.struct(F.lit(c).alias("column"), F.lit(numeric).alias("numeric"), F.count(F.lit(1)).alias("n_rows"), F.count(cell).alias("n_values"), F.hll_sketch_agg(cell.cast("string"), LG).alias("distinct_state"), ranks.alias("ranks"), common.alias("common"))

    row = df.agg(*[of(c).alias(f"c{k}") for k, c in enumerate(columns)])
    return row.select(F.inline(F.array(*[f"c{k}" for k in range(len(columns))])))


def merged(states: DataFrame, accuracy: int = ACCURACY) -> DataFrame:
    """One state for each column, of all parts together."""
    return states.groupBy("column").agg(
        F.bool_or("numeric").alias("numeric"), F.sum("n_rows").alias("n_rows"), F.sum("n_values").alias("n_values"), F.hll_union_agg("distinct_state").alias("distinct_state"),
        F.kll_merge_agg_double("ranks", accuracy).alias("ranks"), F.call_function("approx_top_k_combine", F.col("common"), F.lit(ITEMS)).alias("common"),
    )


def figures(states: DataFrame, shares: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """column, n_rows, n_values, n_distinct, q25, q50, q75 (by shares), mode, mode_count of merged states; of equally frequent modes the smallest."""
    some = F.col("n_values") > 0
    quantiles = [F.when(some & F.col("numeric"), F.kll_sketch_get_quantile_double("ranks", F.lit(s))).alias(f"q{round(100 * s)}") for s in shares]
    counts = F.call_function("approx_top_k_estimate", F.col("common"), F.lit(ITEMS))
    best = F.array_min(F.transform(F.filter(counts, lambda x: x["item"].isNotNull()), lambda x: F.struct((-x["count"]).alias("n"), x["item"].alias("item"))))
    out = states.withColumn("_best", F.when(some, best))
    return out.select("column", "n_rows", "n_values", F.hll_sketch_estimate("distinct_state").alias("n_distinct"), *quantiles, F.col("_best.item").alias("mode"), (-F.col("_best.n")).alias("mode_count"))


class ProfileStore:
    """States in an append-only table: each file or job adds its own, and a profile of all is read without their rows."""

    def __init__(self, spark: SparkSession, path: str, accuracy: int = ACCURACY):
        self.spark, self.path, self.accuracy = spark, path.rstrip("/"), accuracy

    def add(self, df: DataFrame, columns: list[str]) -> None:
        state(df, columns, self.accuracy).coalesce(1).write.mode("append").parquet(self.path)

    def states(self) -> DataFrame | None:
        try:
            return self.spark.read.parquet(self.path)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return None

    def profile(self) -> DataFrame | None:
        """The figures of all that was added; None before anything was."""
        found = self.states()
        return None if found is None else figures(merged(found, self.accuracy))

    def compact(self) -> None:
        """All states as one row a column, under the same path."""
        from millrace.runtime import cut

        found = self.states()
        if found is not None:
            cut(merged(found, self.accuracy)).coalesce(1).write.mode("overwrite").parquet(self.path)
