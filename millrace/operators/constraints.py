"""Business rules as expressions, counted in one pass, and drift of figures between two tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def violations(df: DataFrame, rules: list[tuple]) -> DataFrame:
    """(rule, column, violations) for unique, non_negative, not_null and one_of rules.

    rules: (kind, column) or ("one_of", column, values). Row rules share one
    aggregation; a unique rule counts surplus rows by a shuffle of its column.
    """
    row_rules = {"non_negative": lambda c, _: c < 0, "not_null": lambda c, _: c.isNull(), "one_of": lambda c, v: ~c.isin(v)}
    simple = [r for r in rules if r[0] in row_rules]
    parts = []
    if simple:
        counted = df.agg(*[F.count_if(F.coalesce(row_rules[r[0]](F.col(r[1]), r[2] if len(r) > 2 else None), F.lit(False))).alias(f"v{k}") for k, r in enumerate(simple)])
        parts.append(counted.select(F.inline(F.array(*[F.struct(F.lit(r[0]).alias("rule"), F.lit(r[1]).alias("column"), F.col(f"v{k}").alias("violations")) for k, r in enumerate(simple)]))))
    for r in rules:
        if r[0] == "unique":
            groups = df.filter(F.col(r[1]).isNotNull()).groupBy(r[1]).agg(F.count(F.lit(1)).alias("n"))
            parts.append(groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("violations")).select(F.lit("unique").alias("rule"), F.lit(r[1]).alias("column"), "violations"))
        elif r[0] not in row_rules:
            raise ValueError(f"unknown rule: {r[0]}")
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def drift(before: DataFrame, after: DataFrame, columns: list[str], tolerance: float = 0.1) -> DataFrame:
    """(column, mean_before, mean_after, null_before, null_after, drifted) of numeric columns."""

    def figures(df: DataFrame, suffix: str) -> DataFrame:
        row = df.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.avg(F.col(c).isNull().cast("int")).alias(f"n_{c}") for c in columns])
        return row.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"m_{c}").alias(f"mean_{suffix}"), F.col(f"n_{c}").alias(f"null_{suffix}")) for c in columns])))

    both = figures(before, "before").join(figures(after, "after"), "column")
    moved = F.abs(F.col("mean_after") - F.col("mean_before")) > tolerance * F.greatest(F.abs("mean_before"), F.lit(1e-9))
    return both.withColumn("drifted", moved | (F.abs(F.col("null_after") - F.col("null_before")) > tolerance))
