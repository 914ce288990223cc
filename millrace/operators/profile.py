"""Profiles: type votes, deterministic samples, medians, modes, quartiles, distinct counts.

A profile is a small DataFrame, one row a column. Each figure is one
aggregation over cells stacked as (row_id, column, value), so that all columns
share a scan and a shuffle of partial results.
"""

from __future__ import annotations

import math

from millrace.functions import hashing, numeric, text
from millrace.operators.shape import sampled, stacked
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NUMERIC_SHARE, CAPACITY = 0.5, 100_000
#: Values that a quantile takes into one task at most, and the accuracy of the sketches that bracket it.
ROOM, ACCURACY = 500_000, 10_000


def type_votes(df: DataFrame, columns: list[str], row_id: str, every: int = 10, share: float = NUMERIC_SHARE) -> DataFrame:
    """column, n_sampled, n_numeric, is_numeric by vote of the sampled rows; nulls vote against."""
    cells = stacked(sampled(df, row_id, every), columns, row_id)
    out = cells.groupBy("column").agg(F.count(F.lit(1)).alias("n_sampled"), F.sum(numeric.numeric_like(F.col("value")).cast("long")).alias("n_numeric"))
    return out.withColumn("is_numeric", F.col("n_numeric") / F.col("n_sampled") >= share)


def reservoir(df: DataFrame, columns: list[str], row_id: str, capacity: int = CAPACITY, salt: str = "v1") -> DataFrame:
    """column, row_id, value, priority: of each column's non-null cells those with the smallest hash priority.

    A count of the cells, a row a column, bounds the priorities first, so that
    little more than the sample is shuffled and ranked however many tasks there
    are. The bound lies twelve standard deviations above what the sample takes
    on average, so it is short of the sample once in 10**32 columns.
    """
    cells = stacked(df, columns, row_id).filter("value is not null")
    row = df.agg(*[F.count(f"`{c}`").alias(f"n{k}") for k, c in enumerate(columns)]).first() if columns else {}
    counts = {c: row[f"n{k}"] for k, c in enumerate(columns)}
    room = capacity + 12 * math.sqrt(capacity) + 100
    large = {c: f"{int(room / n * 2**64):016x}" for c, n in counts.items() if n > 2 * room}
    ranked = cells.withColumn("priority", hashing.priority(F.concat(F.col("column"), F.lit(f"_{salt}")), F.col("row_id")))
    if large:
        bound = F.create_map(*[F.lit(x) for pair in large.items() for x in pair])[F.col("column")]
        ranked = ranked.filter(bound.isNull() | (F.col("priority") <= bound))
    order = Window.partitionBy("column").orderBy("priority", "row_id")
    return ranked.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= capacity).drop("_r")


def medians(sample: DataFrame) -> DataFrame:
    """column, median of the sampled values that are numbers."""
    return sample.withColumn("x", numeric.parse(F.trim("value"))).groupBy("column").agg(F.percentile("x", F.lit(0.5)).alias("median"))


def modes_first_seen(df: DataFrame, columns: list[str], row_id: str, every: int = 20) -> DataFrame:
    """column, mode: the most frequent value without outer space and case; of equals the first met."""
    cells = stacked(sampled(df, row_id, every), columns, row_id).filter("value is not null").withColumn("value", F.lower(text.strip(F.col("value"))))
    counts = cells.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"), F.min("row_id").alias("seen"))
    return counts.groupBy("column").agg(F.max_by("value", F.struct("n", -F.col("seen"))).alias("mode"))


def modes_lowest(sample: DataFrame) -> DataFrame:
    """column, mode of a sample's values; of equals the smallest."""
    counts = sample.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("column").agg(F.max("n").alias("n"))
    return counts.join(F.broadcast(best), ["column", "n"]).groupBy("column").agg(F.min("value").alias("mode"))  # a row a column


def quartiles(df: DataFrame, columns: list[str], room: int = ROOM) -> DataFrame:
    """column, q1, q3, iqr of numeric columns, interpolated between ranks; exact in bounded memory."""
    found = quantiles(df, columns, [0.25, 0.75], room)
    rows = [(c, *found[c]) for c in columns]
    return df.sparkSession.createDataFrame(rows, "column string, q1 double, q3 double").withColumn("iqr", F.col("q3") - F.col("q1"))


def quantiles(df: DataFrame, columns: list[str], shares: list[float], room: int = ROOM) -> dict[str, list[float | None]]:
    """The quantiles of each numeric column, interpolated between ranks; null and NaN are left out.

    Columns of at most ``room`` values are aggregated directly. Of larger ones
    bounded sketches bracket the two ranks in question, the rows at and between
    the ends are counted, and what lies between is bracketed again, until it
    holds at most ``room`` rows, whose ranks then give the exact result.
    """
    value = {c: F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double")) for c in columns}
    counts = df.agg(*[F.count(value[c]).alias(f"n{k}") for k, c in enumerate(columns)]).first() if columns else {}
    n = {c: counts[f"n{k}"] for k, c in enumerate(columns)}
    out: dict[str, list[float | None]] = {c: [None] * len(shares) for c in columns}
    few = [c for c in columns if 0 < n[c] <= room]
    if few:
        row = df.agg(*[F.percentile(value[c], F.array(*map(F.lit, shares))).alias(f"q{k}") for k, c in enumerate(few)]).first()
        out |= {c: list(row[f"q{k}"]) for k, c in enumerate(few)}
    ranks = {(c, k): Ranks(n[c], share) for c in columns if n[c] > room for k, share in enumerate(shares)}
    while wide := {key: r for key, r in ranks.items() if r.held > room}:
        ends = [F.percentile_approx(F.when(r.holds(value[c]), value[c]), r.places(), ACCURACY).alias(f"b{i}") for i, ((c, _), r) in enumerate(wide.items())]
        row = df.agg(*ends).first()
        brackets = [row[f"b{i}"] for i in range(len(wide))]
        tests = [x for ((c, _), r), (low, high) in zip(wide.items(), brackets, strict=True) for x in (value[c] < low, value[c] <= low, value[c] < high, value[c] <= high)]
        row = df.agg(*[F.count_if(t).alias(f"t{i}") for i, t in enumerate(tests)]).first()
        for i, r in enumerate(wide.values()):
            r.narrow(*brackets[i], *[row[f"t{4 * i + j}"] for j in range(4)])
    left = {key: r for key, r in ranks.items() if r.held}
    values: dict[int, list[float]] = {}
    if left:
        cells = F.array(*[F.when(r.holds(value[c]), F.struct(F.lit(i).alias("i"), value[c].alias("v"))) for i, ((c, _), r) in enumerate(left.items())])
        for x in df.select(F.explode(cells).alias("x")).filter("x is not null").select("x.*").collect():  # room rows a rank
            values.setdefault(x["i"], []).append(x["v"])
    for i, r in enumerate(left.values()):
        r.settle(sorted(values[i]))
    for (c, k), r in ranks.items():
        out[c][k] = r.value()
    return out


class Ranks:
    """The two ranks around a quantile of n values, and the open interval of values in which unknown ones lie."""

    def __init__(self, n: int, share: float):
        self.place = share * (n - 1)
        self.known: dict[int, float] = {}
        self.wanted = sorted({math.floor(self.place), min(math.floor(self.place) + 1, n - 1)})
        self.low, self.high, self.below, self.held = None, None, 0, n  # below: rows that are not above low

    def holds(self, value: Column) -> Column:
        out = value.isNotNull()
        if self.low is not None:
            out = out & (value > self.low)
        return out if self.high is None else out & (value < self.high)

    def places(self) -> list[float]:
        open_ = [r - self.below for r in self.wanted if r not in self.known]
        return [max(0.0, open_[0] / self.held - 4 / ACCURACY), min(1.0, (open_[-1] + 1) / self.held + 4 / ACCURACY)]

    def narrow(self, low: float, high: float, under_low: int, to_low: int, under_high: int, to_high: int) -> None:
        for r in self.wanted:
            if under_low <= r < to_low:
                self.known[r] = low
            elif under_high <= r < to_high:
                self.known[r] = high
        self.low, self.high, self.below = low, high, to_low
        self.held = 0 if len(self.known) == len(self.wanted) else under_high - to_low

    def settle(self, values: list[float]) -> None:
        self.known |= {r: values[r - self.below] for r in self.wanted if r not in self.known}

    def value(self) -> float:
        a, b = (self.known[r] for r in (self.wanted[0], self.wanted[-1]))
        return a + (self.place - self.wanted[0]) * (b - a) if a != b else a


def distinct_counts(df: DataFrame, columns: list[str], exact: bool = True) -> DataFrame:
    """column, n_distinct, n_rows."""
    if exact:  # a shuffle of distinct cells, no set of values in one task
        cells = stacked(df, columns, columns[0]).select("column", "value")
        return cells.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")).groupBy("column").agg(F.count("value").alias("n_distinct"), F.sum("n").alias("n_rows"))
    row = df.agg(*[F.approx_count_distinct(f"`{c}`").alias(c) for c in columns], F.count(F.lit(1)).alias("_n"))
    return row.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("n_distinct"), F.col("_n").alias("n_rows")) for c in columns])))


def column_classes(df: DataFrame, columns: list[str], categorical: float = 0.05, numeric_share: float = 0.9) -> DataFrame:
    """column, unique_ratio, numeric_ratio, suggestion: categorical, numeric or none."""
    counts = distinct_counts(df, columns)
    shares = numeric_candidates(df, columns, numeric_share).select("column", "numeric_ratio")
    ratio = F.col("n_distinct") / F.col("n_rows")
    kind = F.when(ratio < categorical, "categorical").when(F.col("numeric_ratio") >= numeric_share, "numeric")
    return counts.join(shares, "column").select("column", ratio.alias("unique_ratio"), "numeric_ratio", kind.alias("suggestion"))


def numeric_candidates(df: DataFrame, columns: list[str], threshold: float = 0.7) -> DataFrame:
    """column, numeric_ratio, is_numeric: the share of non-null values that the tolerant parser reads."""
    cells = stacked(df, columns, columns[0]).filter("value is not null")
    out = cells.groupBy("column").agg(F.avg(numeric.parse_enhanced(F.col("value")).isNotNull().cast("int")).alias("numeric_ratio"))
    return out.withColumn("is_numeric", F.col("numeric_ratio") >= threshold)


def profile(df: DataFrame, row_id: str, numeric_every: int = 10, mode_every: int = 20, capacity: int = CAPACITY) -> DataFrame:
    """column, n_sampled, n_numeric, is_numeric, median, mode of all columns but the row number."""
    columns = [c for c in df.columns if c != row_id]
    votes = type_votes(df, columns, row_id, numeric_every)
    middle = medians(reservoir(sampled(df, row_id, numeric_every), columns, row_id, capacity))
    modes = modes_first_seen(df, columns, row_id, mode_every)
    out = votes.join(middle, "column", "left").join(modes, "column", "left")
    return out.withColumn("median", F.when(F.col("is_numeric"), F.col("median")))


def worker_profile(df: DataFrame, columns: list[str], row_id: str, every: int = 1, capacity: int | None = None) -> dict[str, dict]:
    """Votes, median and mode of each column by name: of equally frequent values the smallest, a median for numeric columns only.

    Both are those of every cell of the sampled rows, or of a reservoir's if
    capacity is given.
    """
    rows = sampled(df, row_id, every)
    cells = stacked(rows, columns, row_id).filter("value is not null") if capacity is None else reservoir(rows, columns, row_id, capacity)
    votes = type_votes(df, columns, row_id, every).join(modes_lowest(cells), "column", "left")
    if capacity is not None:
        votes = votes.join(medians(cells), "column", "left")
    out = as_dict(votes)
    numbers = [c for c in columns if c in out and out[c]["is_numeric"]]
    found: dict = {}
    if capacity is None and numbers:
        found = quantiles(rows.select(*[numeric.parse(F.trim(F.col(f"`{c}`").cast("string"))).alias(c) for c in numbers]), numbers, [0.5])
    for c, s in out.items():
        s["median"] = (found[c][0] if c in found else s.get("median")) if s["is_numeric"] else None
    return out


def fallbacks(df: DataFrame, stats: dict[str, dict], row_id: str) -> dict[str, dict]:
    """Statistics for the columns of which the samples have told none: the median of all numbers, the mode of all texts.

    Of equally frequent texts the smallest. No job if every column has one.
    """
    kinds = dict(df.dtypes)
    lacking = [c for c in df.columns if c != row_id and (stats.get(c) or {}).get("median") is None and (stats.get(c) or {}).get("mode") is None]
    out = dict(stats)
    numbers = [c for c in lacking if kinds[c] in ("tinyint", "smallint", "int", "bigint", "float", "double") or kinds[c].startswith("decimal")]
    if numbers:
        out |= {c: {"is_numeric": True, "mode": None, **(stats.get(c) or {}), "column": c, "median": v[0]} for c, v in quantiles(df, numbers, [0.5]).items()}
    words = [c for c in lacking if kinds[c] == "string"]
    if words:
        modes = modes_lowest(stacked(df, words, row_id).filter("value is not null"))
        found = {r["column"]: r["mode"] for r in modes.collect()}
        out |= {c: {"is_numeric": False, "median": None, **(stats.get(c) or {}), "column": c, "mode": found.get(c)} for c in words}
    return out


def as_dict(stats: DataFrame) -> dict[str, dict]:
    """A profile on the driver; it has one row a column."""
    return {r["column"]: r.asDict() for r in stats.collect()}
