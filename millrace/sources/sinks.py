"""Writers: CSV, Parquet, JSON reports."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write(df: DataFrame, path: str, mode: str = "overwrite", one_file: bool = False) -> None:
    """By suffix: .csv with a header, .jsonl as JSON lines, .json as an array a file, .xlsx for a small table, .parquet (or none) as snappy Parquet; anything else is an error.

    one_file writes through a single task and is for small results.
    """
    from millrace.sources.readers import located, suffix

    path, kind = located(path), suffix(path)
    out = (df.coalesce(1) if one_file else df).write.mode(mode)
    if kind == "csv":
        out.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    elif kind in ("jsonl", "ndjson"):
        out.json(path)
    elif kind == "json":
        arrays(df.coalesce(1) if one_file else df).write.mode(mode).text(path)
    elif kind == "xlsx":
        from millrace.sources.xlsx import write_workbook

        write_workbook(df, path)
    elif kind in ("parquet", ""):
        out.option("compression", "snappy").parquet(path)
    else:
        raise ValueError(f"unsupported output type: {path}")


def arrays(df: DataFrame) -> DataFrame:
    """The lines of one JSON array for each task: what a text file of them holds is a document."""
    lines = df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("value"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun = False
        for batch in batches:
            texts = batch.column(0).to_pylist()
            out = [("," if begun or k else "[") + t for k, t in enumerate(texts)]
            begun = begun or bool(out)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["]" if begun else "[]"])], names=["value"])

    return lines.mapInArrow(run, "value string")


def write_report(spark: SparkSession, report: dict, path: str) -> None:
    """A report as one JSON document, through Spark's file systems."""
    from millrace.sources.files import write_bytes
    from millrace.sources.readers import located

    write_bytes(spark, located(path), json.dumps(report, default=str, ensure_ascii=False, indent=2).encode())
