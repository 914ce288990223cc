"""Hashes that tell rows apart, hot rows, groups without all pairs, and bounds of the ratio."""

from difflib import SequenceMatcher

import numpy as np
import pytest
from helpers import SMALL
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from millrace.functions import hashing, privacy
from millrace.operators import dedupe, meetings
from millrace.plans import pipeline
from pyspark.sql import functions as F


def test_row_hash_tells_cells_apart(spark):
    rows = [("a|b", "c"), ("a", "b|c"), (None, "c"), ("nan", "c"), ("", "c"), ("1:a", ""), ("-", "-"), (None, None), ("", ""), ("a", "b|c")]
    df = spark.createDataFrame(rows, "x string, y string")
    hashes = [r[0] for r in df.select(hashing.row_hash([F.col("x"), F.col("y")])).collect()]
    assert len(set(hashes)) == 9 and hashes[1] == hashes[-1]
    joined = [r[0] for r in df.select(hashing.joined_hash([F.col("x"), F.col("y")])).collect()]
    assert joined[0] == joined[1] and joined[2] == joined[3]


def test_pipeline_drops_no_row_for_its_separators(spark):
    df = spark.createDataFrame([(0, "a|b", "c"), (1, "a", "b|c"), (2, None, "c"), (3, "nan", "c"), (4, "a|b", "c")], "row_id long, x string, y string")
    assert sorted(r["row_id"] for r in pipeline.clean_table(df, near_threshold=None, merge=False).cleaned.collect()) == [0, 1, 2, 3]


def test_repeats_of_a_hot_row(spark):
    """A third of the rows are one: their first is found by salt, and the rest are what keep_first drops."""
    df = spark.range(9000).selectExpr("id", "if(id % 3 = 1, 'hot', concat('k', id div 2)) as k")
    kept = {r["id"] for r in dedupe.keep_first(df, F.col("k"), "id").collect()}
    gone = dedupe.repeats(df, F.col("k"), "id")
    assert gone.columns == df.columns and {r["id"] for r in gone.collect()} == set(range(9000)) - kept
    plan = gone._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "hashpartitioning(_key" in plan and "_salt" in plan


def texts(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet").selectExpr("doc_id as id", "substring(text, 1, 60) as s")


def test_groups_grow_with_rows_and_not_with_pairs(spark):
    hot = lambda n: spark.range(n).selectExpr("id", "if(id % 3 = 0, concat('the very same long text of a hot bucket ', id % 7), sha2(string(id), 256)) as s")
    for n in (600, 1800):
        got = dedupe.near_groups(hot(n), F.col("s"), "id", 0.9, every=5)
        assert n // 3 * 0.5 < got.count() <= n // 3 * hashing.BANDS
        best = got.groupBy("row_id").agg(F.max("similarity").alias("m")).collect()
        assert {r["row_id"] for r in best} >= {i for i in range(0, n, 3) if i > 15} and all(r["m"] >= 0.9 for r in best)


def test_each_row_of_a_group_is_similar_to_its_representative(spark):
    df = texts(spark)
    known = {r["id"]: r["s"] for r in df.collect()}
    for r in dedupe.near_groups(df, F.col("s"), "id", 0.6, every=2).collect():
        assert r["representative_id"] % 2 == 0 and r["row_id"] != r["representative_id"]
        assert r["similarity"] == pytest.approx(SequenceMatcher(None, known[r["row_id"]], known[r["representative_id"]]).ratio()) and r["similarity"] >= 0.6


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.text("abc é😀", max_size=12), st.text("abc é😀", max_size=12)), min_size=1, max_size=30))
def test_bounds_are_never_below_the_ratio(spark, pairs):
    df = spark.createDataFrame(pairs, "text string, candidate string")
    a, b = F.col("text"), F.col("candidate")
    for r in df.select(a, b, dedupe.length_bound(a, b).alias("l"), dedupe.ratio_bound(a, b).alias("r")).collect():
        ratio = SequenceMatcher(None, r["text"], r["candidate"]).ratio()
        assert ratio <= r["r"] <= r["l"]


def test_bounds_let_most_pairs_go(spark):
    rows = spark.read.parquet(f"{SMALL.replace('0.001', '0.01')}/customer.parquet").selectExpr("c_custkey", "concat_ws(' ', c_custkey, c_name, c_nationkey) as s")
    pairs = dedupe.near_candidates(rows, F.col("s"), "c_custkey").cache()
    a, b = F.col("text"), F.col("candidate")
    left = pairs.filter(dedupe.length_bound(a, b) >= 0.85).filter(dedupe.ratio_bound(a, b) >= 0.85)
    assert 0 < left.count() < pairs.count()
    same = lambda df: {(r["row_id"], r["candidate_id"]) for r in df.collect()}
    assert same(dedupe.scored(pairs, 0.85, "ratio")) == same(pairs.filter(dedupe.ratio(a, b) >= 0.85))
    pairs.unpersist()


def test_vault(spark, tmp_path):
    vault = privacy.TokenVault(spark, str(tmp_path / "v"), "salt")
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None)], "id int, who string")
    assert vault.read().count() == 0 and vault.add(df, "who").count() == 2 and vault.add(df, "who").count() == 0
    hidden = privacy.protect(df, {"who": "tokenize"}, vault=vault)
    assert {r["who"] for r in hidden.collect()} == {r["token"] for r in vault.read().collect()} | {None}
    assert sorted(map(tuple, vault.reveal(hidden, "who").collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    other = privacy.TokenVault(spark, str(tmp_path / "w"), "pepper")
    other.add(df, "who")
    assert not {r["token"] for r in other.read().collect()} & {r["token"] for r in vault.read().collect()}


def test_vault_refuses_two_values_of_a_token(spark, tmp_path, monkeypatch):
    vault = privacy.TokenVault(spark, str(tmp_path / "v"), "salt")
    monkeypatch.setattr(privacy, "token", lambda c, salt="", prefix="tok_": F.concat(F.lit("t"), F.length(c)))
    vault.add(spark.createDataFrame([("a",)], "who string"), "who")
    with pytest.raises(privacy.TokenCollision):
        vault.add(spark.createDataFrame([("b",)], "who string"), "who")
    with pytest.raises(privacy.TokenCollision):
        vault.add(spark.createDataFrame([("xx",), ("yy",)], "who string"), "who")
    assert vault.read().count() == 1


@pytest.mark.parametrize("how,threshold", [("jaccard", 0.6), ("ratio", 0.85), ("levenshtein", 0.85)])
def test_bounds_of_many_samples_lose_no_pair(spark, monkeypatch, how, threshold):
    """Pairs of customers, a third of which share a bucket: few are scored, those of several tiles too, and none is lost. Odd rows come along."""
    monkeypatch.setattr(meetings, "TILE", 40)
    monkeypatch.setattr(meetings, "FEW", 3)
    odd = spark.createDataFrame([(900_000 + i, s) for i, s in enumerate(["", "", None, "abc", "😀" * 70, "😀" * 69 + "x", "Customer#0000", "Customer#00000"])], "id long, s string")
    df = spark.read.parquet(f"{SMALL.replace('0.001', '0.01')}/customer.parquet").filter("c_custkey < 500").selectExpr("c_custkey as id", "concat_ws(' ', c_custkey, c_name, c_nationkey) as s").union(odd)
    every = lambda **how: dedupe.near_candidates(df, F.col("s"), "id", every=3, **how)
    want = {tuple(r) for r in dedupe.scored(every(), threshold, how).collect()}
    got = {tuple(r) for r in dedupe.near_duplicates(df, F.col("s"), "id", threshold=threshold, how=how, every=3).collect()}
    assert got == want and len(want) > 5 and every(how=how, threshold=threshold).count() < every().count() / 5


def test_pairs_come_up_once_and_are_not_shuffled(spark):
    df = spark.range(3000).selectExpr("id", "concat('the very same long text of a hot bucket ', id % 7) as s")
    pairs = dedupe.candidate_pairs(df, F.col("s"), "id", every=10)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan.split("Join")[0] and "Exchange" not in plan.split("MapInArrow")[0]
    rows = [tuple(r) for r in pairs.collect()]
    assert len(rows) == len(set(rows)) >= 3000 * 300 // 7 and all(a != b and b % 10 == 0 for a, b in rows)


def test_each_part_of_the_rows_has_a_task_of_its_own(spark):
    """Dealt by hash, eight cells would meet in a few of eight tasks."""
    sets = spark.range(4000).selectExpr("id as row_id", "'' as text", "array(concat('k', id % 9)) as keys")
    pairs = meetings.pairs(sets, sets.filter("row_id % 10 = 0"))
    cells = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tasks = {r["p"]: r["n"] for r in pairs.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    assert len(tasks) == min(cells, max(1, spark.sparkContext.defaultParallelism)) and sum(tasks.values()) == sum((i % 9 == j % 9) and i != j for i in range(4000) for j in range(0, 4000, 10))


def test_ids_that_repeat_give_a_pair_once(spark):
    """As DISTINCT does; a row without a number meets nothing."""
    rows = [(1, ["a"]), (1, ["b"]), (2, ["a", "b"]), (2, ["b"]), (3, []), (4, ["c"]), (None, ["a"]), (5, ["a", "a"]), (5, None)]
    sets = spark.createDataFrame(rows, "row_id long, keys array<string>").withColumn("text", F.lit(""))
    for kind in ("long", "string"):
        typed = sets.withColumn("row_id", F.col("row_id").cast(kind))
        got = [tuple(r) for r in meetings.pairs(typed, typed).collect()]
        want = {(a, b) for a in (1, 2, 5) for b in (1, 2, 5) if a != b}
        assert len(got) == len(want) and {(int(a), int(b)) for a, b in got} == want


def test_rows_of_the_same_keys_leave_python_together():
    """Lists are far fewer than pairs and none is too long for Spark to expand at once."""
    import random

    import pyarrow as pa

    rng = random.Random(3)
    keys = lambda n: [[f"k{k}" for k in range(12) if rng.random() < 0.1] + ["hot"] * (rng.random() < 0.5) for _ in range(n)]
    known, own = keys(3000), keys(2000)
    array = lambda of: pa.array(of, pa.list_(pa.string()))
    tile, got, sent = meetings.Holders(pa.array(range(3000)), array(known)), [], 0
    for batch in tile.meet(pa.array(range(10_000, 12_000)), array(own)):
        for rows, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            assert len(rows) * len(found) <= meetings.EXPANDED
            sent += len(rows) + len(found)
            got += [(a - 10_000) * 3000 + b for a in rows for b in found]
    held = [set(k) for k in known]
    want = [a * 3000 + b for a, k in enumerate(map(set, own)) for b, other in enumerate(held) if k & other]
    assert sorted(got) == want and sent < len(want) / 3


def test_buckets_in_batches_are_those_of_expressions(spark, monkeypatch):
    monkeypatch.setattr(hashing, "KEPT", 30)
    df = texts(spark).union(spark.createDataFrame([(-1, "é😀abc"), (-2, "abcde"), (-3, "abcdef" * 20)], "id long, s string"))
    both = df.select(hashing.shingles(F.col("s")).alias("x")).filter("size(x) > 0").select(hashing.sha256_buckets(F.col("x")).alias("a"), hashing.lsh_buckets(hashing.minhash(F.col("x"))).alias("b"))
    assert both.filter("not a <=> b").count() == 0 and both.count() > 100


def test_ratios_of_many_pairs_are_those_of_difflib():
    import random

    rng = random.Random(5)
    word = lambda n, of: "".join(rng.choices(of, k=n))
    pairs = [(word(rng.randrange(30), of), word(rng.randrange(30), of)) for of in ("ab", "abc é😀", "0123456789") for _ in range(1500)]
    pairs += [(f"{i} Customer#{i:09d} {i % 25}", f"{k} Customer#{k:09d} {k % 25}") for i, k in ((rng.randrange(10**6), rng.randrange(10**6)) for _ in range(3000))]
    pairs += [("", ""), ("", "a"), ("a", ""), ("ab" * 99 + "c", "ba" * 99 + "c"), ("ab" * 100, "ba" * 100), ("x", "ab" * 150), ("\ud800a", "a\ud800")]
    got = dedupe.matching_blocks(*map(list, zip(*pairs, strict=True)))
    assert got.tolist() == [SequenceMatcher(None, a, b).ratio() for a, b in pairs]
    assert dedupe.matching_blocks([], []).tolist() == []


def test_short_pairs_do_not_meet_difflib(monkeypatch):
    monkeypatch.setattr(dedupe, "SequenceMatcher", None)
    assert dedupe.matching_blocks(["abcd", "1 Customer#01 7"], ["bcde", "2 Customer#02 7"]).tolist() == [0.75, 26 / 30]


def test_edits_of_many_samples_are_exact():
    import random

    import pyarrow as pa

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, above = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (x != y)))
        return row[-1]

    rng = random.Random(7)
    for width in (32, 64):
        known = ["".join(rng.choices("abc é😀", k=rng.randrange(1, width + 1))) for _ in range(60)] + ["a" * width]
        tile = meetings.Tile(pa.array(range(61)), pa.array(known), pa.array([["k"]] * 61), "levenshtein", 0.5, 0)
        assert tile.word(0).itemsize * 8 == width
        for text in ["", "x", "abc", *known[:5], known[0] * 4]:
            codes = np.array([[tile.codes.get(sign, 0)] for sign in text], np.intp).reshape(-1, 1)
            assert tile.edits(codes, np.array([len(text)]), np.zeros(61, np.intp), np.arange(61)).tolist() == [plain(text, t) for t in known]
        texts = ["", "x", "abc", *known[:5], known[0] * 4]
        want = [[i for i, t in enumerate(known) if 1 - plain(text, t) / max(len(text), len(t)) >= 0.5] for text in texts]
        assert [tile.near(text, np.arange(61)).tolist() for text in texts] == want
        got = dict(tile.close(texts, [(k, np.arange(61)) for k in range(len(texts))]))  # many rows in step
        assert [got.get(k, np.arange(0)).tolist() for k in range(len(texts))] == want
