"""States of parts merge into that of the whole, within the stated bounds."""

import random

from millrace.operators import sketches as S


def table(spark, n, seed=1):
    r = random.Random(seed)
    rows = [(i, None if i % 13 == 0 else float("nan") if i % 17 == 0 else r.gauss(0, 100), f"v{min(int(r.expovariate(0.01)), 3000)}", None) for i in range(n)]
    return spark.createDataFrame(rows, "i long, x double, s string, none int").repartition(5), rows


def same(got, want):
    """Rows are equal but for the distinct values, which lie within five standard errors of each other."""
    assert [r.asDict() | {"n_distinct": 0} for r in got] == [r.asDict() | {"n_distinct": 0} for r in want]
    assert all(abs(g["n_distinct"] - w["n_distinct"]) <= 5 * 1.04 / 2 ** (S.LG / 2) * w["n_distinct"] for g, w in zip(got, want, strict=True))


def test_parts_are_the_whole(spark):
    df, _ = table(spark, 3000)
    columns = ["i", "x", "s", "none"]
    whole = S.figures(S.state(df, columns)).orderBy("column").collect()
    parts = [S.state(df.filter(f"i % 3 = {k}"), columns) for k in range(3)]
    both = S.figures(S.merged(parts[0].union(parts[1]).union(parts[2]))).orderBy("column").collect()
    same(both, whole)  # fewer values than the accuracy: all but the distinct values is exact


def test_bounds_on_more_values_than_a_state_holds(spark):
    df, rows = table(spark, 60_000)
    parts = [S.state(df.filter(f"i % 4 = {k}"), ["x", "s", "i"], 200) for k in range(4)]
    got = {r["column"]: r for r in S.figures(S.merged(parts[0].union(parts[1]).union(parts[2]).union(parts[3]), 200)).collect()}
    x = sorted(r[1] for r in rows if r[1] is not None and r[1] == r[1])
    assert got["x"]["n_values"] == len(x) and got["x"]["n_rows"] == 60_000
    for share in (0.25, 0.5, 0.75):
        value = got["x"][f"q{round(100 * share)}"]
        low, high = sum(v < value for v in x) / len(x), sum(v <= value for v in x) / len(x)
        assert low - S.rank_error(200) <= share <= high + S.rank_error(200)
    assert abs(got["i"]["n_distinct"] - 60_000) < 5 * 60_000 * 1.04 / 2 ** (S.LG / 2)
    counts = {}
    for r in rows:
        counts[r[2]] = counts.get(r[2], 0) + 1
    best = min(counts, key=lambda v: (-counts[v], v))
    assert len(counts) <= 0.75 * S.ITEMS and (got["s"]["mode"], got["s"]["mode_count"]) == (best, counts[best])


def test_store_over_jobs(spark, tmp_path):
    df, _ = table(spark, 2000)
    store = S.ProfileStore(spark, str(tmp_path / "p"))
    assert store.profile() is None
    for k in range(4):
        store.add(df.filter(f"i % 4 = {k}"), ["i", "x", "s", "none"])
    store.add(df.filter("i < 0"), ["i", "x", "s", "none"])
    want = S.figures(S.state(df, ["i", "x", "s", "none"])).orderBy("column").collect()
    same(store.profile().orderBy("column").collect(), want)
    store.compact()
    assert store.states().count() == 4
    same(store.profile().orderBy("column").collect(), want)
    none = next(r for r in want if r["column"] == "none")
    assert (none["n_values"], none["n_distinct"], none["q50"], none["mode"]) == (0, 0, None, None)
