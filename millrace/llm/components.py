"""Connected components by alternating large and small stars, in DataFrame operations."""

from __future__ import annotations

from millrace.runtime import cut
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of edges (a, b); label is the smallest node reachable.

    Every round hangs each node's larger neighbours on to the smallest of its
    neighbours, then each node's smaller neighbours on to the smallest of them,
    and cuts the lineage. Rounds grow with the logarithm of a component's width.
    The neighbours of a node with very many are never gathered: their smallest is
    a partial aggregate, and the join that tells it to them reads both sides from
    plain shuffles, of which Spark splits a hot one.
    """
    links = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = _state(links)
    while before[0]:
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = cut(both.groupBy(F.col("a").alias("b")).agg(F.least(F.min("b"), F.first("a")).alias("low")))
        large = links.join(low, "b").select("a", F.col("low").alias("b"))
        # a node has as many smaller neighbours as it has links to them, which are few
        small = large.withColumn("low", F.expr("min(b) over (partition by a)"))
        hung = F.array(F.struct("a", F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))
        links = cut(small.select(F.inline(hung)).filter("a <> b").distinct())
        after = _state(links)
        if after == before:
            break
        before = after
    return links.select(F.col("a").alias("node"), F.col("b").alias("label")).union(links.select(F.col("b"), F.col("b")).distinct())


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))"), F.expr("sum(cast(xxhash64(a, b) % 1000003 as bigint))")).first()
    return tuple(row)
