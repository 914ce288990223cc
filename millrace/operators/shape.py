"""Schemas: flattening nested rows, aligning columns, row numbers."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def flatten_json(value, parent: str = "", sep: str = "."):
    """A nested dict as one level with dotted keys; lists as JSON text; for configuration and tests."""
    if value is None:
        return {}
    if not isinstance(value, dict):
        return {parent: json.dumps(value, ensure_ascii=False) if isinstance(value, list) else value}
    out = {}
    for key, inner in value.items():
        name = f"{parent}{sep}{key}" if parent else str(key)
        if inner is None:
            out[name] = None
        else:
            out |= flatten_json(inner, name, sep)
    return out


def flatten(df: DataFrame, sep: str = ".") -> DataFrame:
    """Every leaf of nested structs as a column with a dotted name; arrays and maps as JSON text."""

    def leaves(schema: T.StructType, path: tuple[str, ...]):
        for field in schema:
            here = (*path, field.name)
            if isinstance(field.dataType, T.StructType):
                yield from leaves(field.dataType, here)
            else:
                c = F.col(".".join(f"`{p}`" for p in here))
                yield (F.to_json(c) if isinstance(field.dataType, (T.ArrayType, T.MapType)) else c).alias(sep.join(here))

    return df.select(*leaves(df.schema, ()))


def at_path(raw: Column, path: str, kind: str = "string") -> Column:
    """A field of JSON text by its path, null where a row lacks it or has another kind; for rows whose fields drift."""
    return F.try_variant_get(F.try_parse_json(raw), path, kind)


def align(df: DataFrame, columns: list[str]) -> DataFrame:
    """Exactly these columns in this order; lacking ones are null."""
    return df.select(*[F.col(f"`{c}`") if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns])


def union_drift(parts: list[DataFrame]) -> DataFrame:
    """Rows of all parts under the sorted union of their columns."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out.select(*[F.col(f"`{c}`") for c in sorted(out.columns)])


def with_row_id(df: DataFrame, name: str = "row_id") -> DataFrame:
    """Rows numbered from 0 in the order of a source that reads alike each time, such as files.

    One pass counts the rows of each partition; a row's number is its place in
    its partition plus the rows of all partitions before, a row a task on the
    driver.
    """
    marked = df.select("*", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().alias("__place"))
    sizes = {r["__part"]: r["n"] for r in marked.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).collect()}
    starts, total = [], 0
    for part in sorted(sizes):
        starts.append((part, total - (part << 33)))
        total += sizes[part]
    begin = F.broadcast(df.sparkSession.createDataFrame(starts, "__part int, __start long"))
    numbered = marked.join(begin, "__part")
    return numbered.select((F.col("__start") + F.col("__place")).alias(name), *[F.col(f"`{c}`") for c in df.columns])


def stacked(df: DataFrame, columns: list[str], row_id: str, value=lambda c: c.cast("string")) -> DataFrame:
    """(row_id, column, value): a row for each cell."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), value(F.col(f"`{c}`")).alias("value")) for c in columns])
    return df.select(F.col(row_id).alias("row_id"), F.inline(cells))


def sampled(df: DataFrame, row_id: str, every: int) -> DataFrame:
    """The rows whose number is divisible."""
    return df.filter(F.col(row_id) % every == 0)


def head(df: DataFrame, row_id: str, n: int, every: int = 1) -> DataFrame:
    """The first n rows by number, of every so many."""
    return sampled(df, row_id, every).orderBy(row_id).limit(n)


def columns_of(df: DataFrame, *kinds: str) -> list[str]:
    return [n for n, k in df.dtypes if k in kinds or k.split("(")[0] in kinds]


def quoted(name: str) -> Column:
    return F.col(f"`{name}`")
