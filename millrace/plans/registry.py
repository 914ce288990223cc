"""Queries by name, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from millrace.runtime import share_code, table
from pyspark.sql import DataFrame, SparkSession

QUERIES: dict = {}
ORACLES: dict = {}


class Tables:
    """The tables of a data folder by name, and the session."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base

    def __call__(self, name: str) -> DataFrame:
        return table(self.spark, self.base, name)


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL that gives the same rows."""

    def register(f):
        def run(spark, base):
            share_code(spark)
            return f(Tables(spark, base))

        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql
        return run

    return register
