import math
import random

import numpy as np
import pytest
from helpers import SMALL, as_rows, duck

from millrace.llm import hard_negatives as H
from pyspark.sql import functions as F


def plain(rows, positives=5, negatives=10, window=(30, 90)):
    """All rows of the result from (id, label, entries) rows, every pair scored."""
    whole = [(i, y, [math.floor(256 * c) for c in v]) for i, y, v in rows if i is not None and y is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    anchors = {(i, y, tuple(v)) for i, y, v in whole if i % 100 == 0}
    out = []
    for i, y, v in anchors:
        scored = sorted(((-sum(a * b for a, b in zip(v, w, strict=False)), j, z) for j, z, w in whole if j != i))
        near = [(-s, j) for s, j, z in scored if z == y][:positives]
        for score, j in near:
            hard = [(-s, m) for s, m, z in scored if z != y and window[0] * score <= -100 * s <= window[1] * score][:negatives]
            out += [(i, j, rank, m, score, s) for rank, (s, m) in enumerate(hard, 1)]
    return sorted(out)


def mined(rows, **options):
    known = rows.select(F.col("vec_id").alias("id"), "label", H.components(F.col("embedding")).alias("x"))
    return sorted(tuple(r) for r in H.mine(known, F.col("id") % 100 == 0, **options).collect())


def frame(spark, rows):
    return spark.createDataFrame([(*r, "z", 1) for r in rows], "vec_id long, label int, embedding array<float>, x string, list int").repartition(3)


def test_query_is_its_sql(spark):
    got = H.op11_hard_negatives(spark, SMALL).toPandas()
    assert len(got) and as_rows(got) == as_rows(duck(SMALL).execute(H.ORACLE).df())


def clustered(n, seed, d=8, copies=0):
    """Vectors around a few centres; the first ``copies`` of every three hundred are the same."""
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(d)] for _ in range(6)]
    rows = []
    for i in range(n):
        c = centres[r.randrange(6)]
        rows.append((i, r.randrange(4), [float(np.float32(0.5 if i % 300 < copies else x + r.gauss(0, 0.2))) for x in c]))
    return rows


@pytest.mark.parametrize("copies", [0, 100])
def test_all_pairs_agree(spark, copies):
    rows = clustered(1500, 5, copies=copies)
    assert mined(frame(spark, rows)) == plain(rows)


def test_small_blocks_and_rounds(spark, monkeypatch):
    """Many blocks a list, many blocks of anchors, many rounds, little held in a task."""
    for name, value in (("BLOCK", 1), ("ANCHORS", 2), ("FIRST", 1), ("GROWTH", 2), ("HELD", 50)):
        monkeypatch.setattr(H, name, value)
    rows = clustered(900, 6)
    known = frame(spark, rows).selectExpr("vec_id as id", "label", "transform(embedding, c -> floor(256 * cast(c as double))) as x")
    got = sorted(tuple(r) for r in H.mine(known, F.col("id") % 10 == 0).collect())
    assert {r[0] for r in got} <= set(range(0, 900, 10)) and [r for r in got if r[0] % 100 == 0] == plain(rows)


def test_odd_rows(spark):
    v = [0.5, 0.25]
    rows = [(None, 1, v), (100, None, v), (200, 1, None), (300, 1, [0.1, None]), (400, 1, [float("nan"), 0.0]), (500, 1, [float("-inf"), 0.0]), (600, 1, []), (700, 1, [0.5]),
            (800, 1, v), (800, 1, v), (800, 2, [0.5, 0.5]), (1, 1, v), (2, 1, v), (2, 1, v), (3, 2, [0.3, 0.1]), (4, 2, [0.3, 0.1]), (5, 3, [0.2, 0.2]), (900, 1, [-0.5, -0.25]), (0, 4, v)]
    padded = [(i, y, x if x is None else x + [0.0] * (2 - len(x))) for i, y, x in rows]
    assert mined(frame(spark, rows)) == plain(padded)


def test_none_and_few_rows(spark):
    none = frame(spark, clustered(3, 1)).filter("vec_id < 0")
    assert mined(none) == []
    for n in (1, 2, 3):
        rows = [(100 * i, i % 2, [1.0, i / 4]) for i in range(n)]
        assert mined(frame(spark, rows)) == plain(rows)
    empty = [(100 * i, i % 2, []) for i in range(6)]
    assert mined(frame(spark, empty)) == plain(empty)


def test_scores_beyond_doubles_are_exact():
    a, b = np.array([[2**40, 1], [3, -(2**40)]]), np.array([[2**20, 1], [2**20 + 1, 7]])
    assert [[int(v) for v in row] for row in H.products(a, b)] == [[sum(int(p) * int(q) for p, q in zip(x, y, strict=True)) for y in b] for x in a]


def test_few_lists_are_visited(spark):
    """On well-separated clusters bounds leave lists out: fewer requests than lists for anchors that have their best."""
    rows = clustered(1200, 9)
    known = frame(spark, rows).selectExpr("vec_id as id", "cast(label as long) as label", "transform(embedding, c -> floor(256 * cast(c as double))) as x")
    index = H.build(known, F.col("id") % 100 == 0)
    near = H.search(index, None, 5, True)
    state = index.anchors.withColumn("asks", F.lit(None).cast("array<struct<at:int,ask:int,score:long>>")).join(near.groupBy("block").agg(F.collect_list(F.struct("at", "ask", "score", "id")).alias("found")), "block")
    left = H._requests(state.select("block", "rows", "asks", "found"), index, 0, len(index.centres), 5, None).selectExpr("sum(size(at)) as n").first()["n"]
    assert left < 0.8 * 12 * len(index.centres)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan = spark.table(index.name).join(H._requests(state.select("block", "rows", "asks", "found"), index, 0, 4, 5, None), ["list", "piece"])._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SelectedBucketsCount" in plan and plan.count("Exchange hashpartitioning(list") == 1  # the index stays where it is
    spark.sql(f"DROP TABLE {index.name}")
