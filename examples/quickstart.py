"""Makes dirty records, profiles and cleans them, and prints what was done: python examples/quickstart.py [folder]."""

from __future__ import annotations

import json
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402

from millrace.operators import profile, shape  # noqa: E402
from millrace.plans import pipeline  # noqa: E402
from millrace.sources import readers, sinks, synthetic  # noqa: E402


def main(folder: str = "quickstart", rows: int = 20_000, spark: SparkSession | None = None) -> dict:
    spark = spark or SparkSession.builder.master("local[*]").getOrCreate()
    sinks.write(synthetic.customers(spark, rows), f"{folder}/dirty.csv")
    dirty = shape.with_row_id(readers.read_any(spark, f"{folder}/dirty.csv"))
    print(f"{dirty.count()} rows, {len(dirty.columns) - 1} columns")
    for column, figures in profile.as_dict(profile.profile(dirty, "row_id")).items():
        print(f"  {column}: numeric {figures['is_numeric']}, median {figures['median']}, mode {figures['mode']}")
    result = pipeline.clean_table(dirty, intensity="medium")
    sinks.write(result.cleaned, f"{folder}/cleaned.csv")
    report = pipeline.report_of(result)
    sinks.write_report(spark, report, f"{folder}/report.json")
    print(json.dumps(report["summary"], indent=2))
    return report


if __name__ == "__main__":
    main(*sys.argv[1:2])
