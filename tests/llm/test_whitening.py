from fractions import Fraction

import numpy as np
import pytest
from helpers import SMALL

from millrace.llm import whitening as W


def plain(vectors, k=16):
    """(n, {row: deviation}, covariance, centred rows) by fractions; vectors of (row, entries) that take part."""
    x = {i: [int(np.floor(64 * float(c))) + 1_000_000 for c in v] for i, v in vectors}
    own = sorted({tuple(v) for v in x.values()})
    n, d = len(own), len(own[0])
    sums = [sum(v[j] for v in own) for j in range(d)]
    mean = [Fraction(s, n) for s in sums]
    centred = np.array([[float(v[j] - mean[j]) for j in range(d)] for v in own])
    deviation = {i: sum((n * v[j] - sums[j]) ** 2 for j in range(d)) for i, v in x.items()}
    return n, deviation, centred.T @ centred / n, {i: np.array([float(v[j] - mean[j]) for j in range(d)]) for i, v in x.items()}


def check(rows, vectors, k=16):
    """The result's rows are those of the plain version, up to each component's sign."""
    n, deviation, covariance, centred = plain(vectors)
    e, q = np.linalg.eigh(covariance)
    e, q = e[::-1], q[:, ::-1]
    by_row = {}
    for r in rows:
        by_row.setdefault(r["vec_id"], {})[r["component"]] = r
    assert set(by_row) == set(deviation) and len(rows) == len(vectors) * min(k, len(e))
    signs = {}
    for i, found in by_row.items():
        assert sorted(found) == list(range(1, min(k, len(e)) + 1))
        for c, r in found.items():
            assert (r["n"], r["deviation"]) == (n, deviation[i]) and 0 <= r["identity_error"] <= 1e-4
            assert r["explained"] == pytest.approx(max(e[c - 1], 0) / np.trace(covariance), rel=1e-4, abs=1e-12)
            if e[c - 1] > 1e-9 * e[0]:
                want = centred[i] @ q[:, c - 1] / np.sqrt(e[c - 1])
                if abs(want) > 1e-3:
                    signs.setdefault(c, np.sign(want * r["whitened"]))
                assert r["whitened"] * signs.get(c, 1) == pytest.approx(want, abs=1e-6)
            else:
                assert r["whitened"] is None
    return signs


def test_query_is_the_plain_whitening(spark):
    table = spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()
    check(W.op12_whitening(spark, SMALL).collect(), [(r["vec_id"], r["embedding"]) for r in table])


ODD = [(1, [0.1, 0.2, -0.3]), (2, None), (3, [0.1, None, 0.2]), (4, [float("nan"), 0.0, 1.0]), (5, [float("inf"), 0.0, 1.0]), (6, [0.5, 0.2, 0.9]), (7, [0.5, 0.2, 0.9]), (8, [-0.4, 0.7, 0.0]), (9, [0.11, 0.21, -0.3]), (10, [0.3, -0.9, 0.25])]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "z", 1) for i, v in rows], "vec_id long, embedding array<float>, id string, x int").repartition(3)


def test_odd_rows_and_copies(spark):
    good = [(i, [np.float32(c) for c in v]) for i, v in ODD if i in (1, 6, 7, 8, 9, 10)]
    check(W.whitened_rows(frame(spark, ODD)).collect(), good)


def test_ids_null_and_repeated(spark):
    rows = [*ODD, (None, [0.1, 0.9, 0.8]), (6, [0.2, 0.2, 0.2]), (2**53 + 1, [0.4, 0.4, 0.1])]
    got = W.whitened_rows(frame(spark, rows)).filter("component = 1").collect()
    assert sorted(str(r["vec_id"]) for r in got) == sorted(["1", "6", "7", "8", "9", "10", "None", "6", str(2**53 + 1)])


def test_shorter_vectors_end_in_zeros(spark):
    short = [(1, [0.25, 0.5]), (2, [0.75]), (3, []), (4, [0.125, -0.5])]
    full = [(i, v + [0.0] * (2 - len(v))) for i, v in short]
    check(W.whitened_rows(frame(spark, short)).collect(), full)


def test_no_rows_one_row_no_variance(spark):
    assert W.whitened_rows(frame(spark, ODD).filter("vec_id < 0")).count() == 0
    assert W.whitened_rows(frame(spark, [(1, []), (2, [])])).count() == 0
    one = W.whitened_rows(frame(spark, [(1, [0.5, 0.25]), (2, [0.5, 0.25])])).collect()
    assert len(one) == 4 and all((r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) == (1, 0, None, None, 0.0) for r in one)


def test_rank_below_dimensions(spark):
    rows = [(i, [i / 8, i / 4, (i * i % 7) / 8]) for i in range(20)]
    check(W.whitened_rows(frame(spark, rows)).collect(), rows)


def test_large_entries(spark):
    """Sums and deviations stay exact; those that no long holds are null."""
    rows = [(1, [1e30, 0.0]), (2, [-1e30, 1.0]), (3, [0.0, 0.5]), (4, [2.0, 0.25])]
    got = {r["vec_id"]: r["deviation"] for r in W.whitened_rows(frame(spark, rows)).collect()}
    assert got == dict.fromkeys((1, 2, 3, 4), None) or got[1] is None and len(got) == 4
    near = np.array([[3, -5], [2**33, 1]])
    assert [int(v) for v in W.deviations(near, np.array([1, 0]), 4)] == [(12 - 1) ** 2 + 20**2, (2**35 - 1) ** 2 + 16]


def test_hot_vector_counts_once(spark):
    rows = spark.range(900).selectExpr("id as vec_id", "if(id % 3 = 0, array(0.5f, 0.5f), array(float(id) / 64, float(id % 7))) as embedding")
    assert W.whitened_rows(rows).first()["n"] == 601
