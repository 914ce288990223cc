import pytest
import itertools
import random
import zlib

from helpers import SMALL
from pyspark.sql import functions as F

from millrace.llm import reshard as R
from millrace.runtime import table


def test_flow_is_cheapest():
    rng = random.Random(2)
    for _ in range(30):
        supply = [rng.randint(0, 4) for _ in range(3)]
        room = [rng.randint(0, 4) for _ in range(2)]
        room.append(max(0, sum(supply) - sum(room)))
        cost = [[rng.randint(0, 3) for _ in room] for _ in supply]
        flow = R.min_cost_flow(supply, room, lambda i, j: cost[i][j])
        assert [sum(x for (i, _), x in flow.items() if i == k) for k in range(3)] == supply
        assert all(sum(x for (_, j), x in flow.items() if j == k) <= room[k] for k in range(3))
        best = None
        choices = [[c for c in itertools.product(range(s + 1), repeat=3) if sum(c) == s] for s in supply]
        for pick in itertools.product(*choices):
            if all(sum(p[j] for p in pick) <= room[j] for j in range(3)):
                price = sum(p[j] * cost[i][j] for i, p in enumerate(pick) for j in range(3))
                best = price if best is None else min(best, price)
        assert sum(x * cost[i][j] for (i, j), x in flow.items()) == best


def check(rows, texts, n=24):
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
        text = (texts[r["doc_id"]] or "").encode()
        assert r["moved"] == (r["shard"] != r["old_shard"]) and r["size"] == len(text) + 8 and r["text_crc32"] == zlib.crc32(text)
    assert set(by) <= set(range(n))
    for slots in by.values():
        assert sorted(slots) == list(range(len(slots)))


def test_query(spark):
    rows = R.op5_reshard(spark, SMALL).collect()
    check(rows, {r["doc_id"]: r["text"] for r in table(spark, SMALL, "documents").collect()})
    loads = [sum(r["size"] for r in rows if r["shard"] == s) for s in range(24)]
    assert len(rows) == 200 and max(loads) - min(loads) <= max(r["size"] for r in rows)
    groups = {}
    for r in rows:
        groups.setdefault(r["text_crc32"], set()).add(r["shard"])
    assert all(len(s) == 1 for s in groups.values())


def test_hot_group_is_spread_and_even(spark):
    rows = spark.createDataFrame([(i, "same text" if i % 3 else f"text {i} " + "x" * (i % 90)) for i in range(3000)], "doc_id long, text string")
    got = R.assign(rows).collect()
    check(got, {r["doc_id"]: r["text"] for r in rows.collect()})
    loads = [sum(r["size"] for r in got if r["shard"] == s) for s in range(24)]
    assert max(loads) < 1.05 * min(loads)


def test_groups_beside_a_hot_one_stay_whole(spark, monkeypatch):
    monkeypatch.setattr(R, "BLOCKS", 16)  # every block holds more than a shard
    text = lambda i: "same text of all these rows" if i % 3 else "warm text, less than a shard" if i % 30 == 0 else f"text {i // 24} " + "x" * (i // 24 % 50)
    rows = spark.createDataFrame([(i, text(i)) for i in range(9000)], "doc_id long, text string")
    got = R.assign(rows).collect()
    texts = {r["doc_id"]: r["text"] for r in rows.collect()}
    check(got, texts)
    shards, loads = {}, [0] * 24
    for r in got:
        shards.setdefault(texts[r["doc_id"]], set()).add(r["shard"])
        loads[r["shard"]] += r["size"]
    assert len(shards) > 300 and len(shards.pop("same text of all these rows")) > 12 and all(len(s) == 1 for s in shards.values())
    assert max(loads) < 1.1 * min(loads)


def test_unchanged_capacities_move_little(spark):
    rows = spark.createDataFrame([(i, f"t{i}" * 5, i % 8) for i in range(2000)], "doc_id long, text string, now int")
    _, plan = R._placed(rows, 8, 8, "doc_id", "text", F.col("now"), None)
    total = sum(len(f"t{i}" * 5) + 8 for i in range(2000))
    assert plan.moved_bytes < 0.02 * total


def test_moves_few_bytes_beside_the_optimum():
    rng = random.Random(5)
    for n_old, n_new in ((8, 8), (8, 9), (9, 8), (16, 24), (24, 5)):
        cells = [(b, 0, rng.randint(1, 900), 1) for b in range(n_old * 100)]
        plan = R.Plan(cells, n_old, [1.0] * n_new)
        assert plan.fewest_bytes > 0
        assert abs(plan.moved_bytes - plan.fewest_bytes) <= (n_old + n_new) * plan.largest_unit  # units are whole
        loads = [sum(c[2] for c, r in zip(sorted(cells), plan.rows, strict=True) if r[2] == j) for j in range(n_new)]
        assert max(loads) - min(loads) <= plan.largest_unit


def placed(spark, path):
    return {r["doc_id"]: r["shard"] for r in spark.read.parquet(path).collect()}


def test_rewrite_fills_a_folder(spark, tmp_path):
    rows = table(spark, SMALL, "documents").withColumn("block", F.lit("mine")).withColumn("_id", F.lit(1)).withColumn("_deal", F.lit(2))
    plan = R.rewrite(rows, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert set(rows.columns) | {"shard"} == set(back.columns) and {r["shard"] for r in back.select("shard").distinct().collect()} <= plan.affected
    want = {r["doc_id"]: r["shard"] for r in R.assign(rows).collect() if r["shard"] in plan.affected}
    assert placed(spark, str(tmp_path / "out")) == want


def test_rewrite_keeps_the_other_shards(spark, tmp_path):
    path = str(tmp_path / "lake")
    # six even shards, one with double the rows and one with none of them: most files may stay
    rows = spark.createDataFrame([(i, f"text {i}" + "x" * (i % 7), "more", 6 if i % 8 == 7 else i % 8) for i in range(4000)], "doc_id long, text string, other string, shard int")
    rows.write.partitionBy("shard").parquet(path)
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "lake").rglob("*.parquet")}
    plan = R.rewrite(spark.read.parquet(path), path, 8, 8, old=F.col("shard"))
    assert placed(spark, path) == {r["doc_id"]: r["shard"] for r in R.assign(rows, 8, 8, old=F.col("shard")).collect()}
    back = spark.read.parquet(path)
    assert back.count() == 4000 and set(back.columns) == set(rows.columns)
    loads = [r["n"] for r in back.groupBy("shard").agg(F.sum(R._size(F.col("text"))).alias("n")).collect()]
    assert len(loads) == 8 and max(loads) < 1.05 * min(loads)
    assert all(p.exists() and p.stat().st_mtime_ns == t for p, t in before.items() if int(p.parent.name[6:]) not in plan.affected)
    R.rewrite(spark.read.parquet(path), path, 3, 8, old=F.col("shard"))  # fewer shards: the folders of the others go
    assert spark.read.parquet(path).count() == 4000 and sorted(p.name for p in (tmp_path / "lake").glob("shard=*")) == ["shard=0", "shard=1", "shard=2"]


@pytest.mark.parametrize("step", ["delete", "move"])
@pytest.mark.parametrize("after", [0, 1, 3])
def test_rewrite_that_breaks_off_half_way(spark, tmp_path, monkeypatch, step, after):
    """Between any two replacements nothing is lost for good: recover puts the rest in place, and no row is there twice."""
    path = str(tmp_path / "lake")
    rows = spark.createDataFrame([(i, f"text {i}" + "x" * (i % 7), 6 if i % 8 == 7 else i % 8) for i in range(2000)], "doc_id long, text string, shard int")
    rows.write.partitionBy("shard").parquet(path)
    real, done = getattr(R.files, step), []

    def broken(*args):
        if len(done) == after:
            raise OSError("lost")
        done.append(args)
        return real(*args)

    with monkeypatch.context() as m:
        m.setattr(R.files, step, broken)
        with pytest.raises(OSError):
            R.rewrite(spark.read.parquet(path), path, 5, 8, old=F.col("shard"))
    with pytest.raises(R.Unfinished):
        R.rewrite(spark.read.parquet(path), path, 5, 8, old=F.col("shard"))
    assert R.recover(spark, path) and not R.recover(spark, path)
    assert placed(spark, path) == {r["doc_id"]: r["shard"] for r in R.assign(rows, 5, 8, old=F.col("shard")).collect()}
    assert spark.read.parquet(path).count() == 2000 and not [p for p in (tmp_path / "lake").iterdir() if p.name.startswith("_reshard")]


def test_rewrite_that_breaks_off_before_the_journal(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "lake")
    rows = spark.createDataFrame([(i, f"text {i}", i % 2) for i in range(300)], "doc_id long, text string, shard int")
    rows.write.partitionBy("shard").parquet(path)
    with monkeypatch.context() as m:
        m.setattr(R.files, "replace_text", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            R.rewrite(spark.read.parquet(path), path, 4, 2, old=F.col("shard"))
    assert placed(spark, path) == {i: i % 2 for i in range(300)} and not R.recover(spark, path)
    R.rewrite(spark.read.parquet(path), path, 4, 2, old=F.col("shard"))
    assert spark.read.parquet(path).count() == 300 and len(set(placed(spark, path).values())) == 4


def test_odd_rows(odd, none):
    got = R.assign(odd).collect()
    assert len(got) == odd.count() and R.assign(none).count() == 0
    assert {r["size"] for r in got if r["doc_id"] in (1, 2)} == {8}
