import re
import struct
from collections import Counter
from math import ceil, isqrt, sqrt

import xxhash
from helpers import SMALL, as_rows

from millrace.llm import mixing as M
from pyspark.sql import functions as F


def spark_hash(*values):
    """Spark's xxhash64: ints as ("i", value), longs and texts as they are; null leaves the seed."""
    seed = 42
    for v in values:
        if v is None:
            continue
        raw = struct.pack("<i", v[1]) if isinstance(v, tuple) else struct.pack("<q", v) if isinstance(v, int) else v.encode()
        seed = xxhash.xxh64(raw, seed).intdigest()
    return seed - (1 << 64) if seed >= 1 << 63 else seed


def targets(sizes, share=1.5, most=2, weights=(5, 2, 1)):
    """{source: target} by stopping and resharing, one source at a time."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, out, open_ = share * sum(sizes.values()), {}, set(names)
    while open_:
        per = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if weight[s] * per > most * sizes[s]]
        if not over:
            return out | {s: weight[s] * per for s in open_}, names
        for s in over:
            out[s] = most * sizes[s]
            left -= most * sizes[s]
            open_.discard(s)
    return out, names


def permutation(seed, s, turn, v, n):
    a = ceil(sqrt(n))
    b = ceil(n / a)
    while True:
        x, y = v % a, v // a
        for r in range(8):
            if r % 2 == 0:
                x = (x + spark_hash(("i", seed), s, turn, ("i", r), y) % a) % a
            else:
                y = (y + spark_hash(("i", seed), s, turn, ("i", r), x) % b) % b
        v = y * a + x
        if v < n:
            return v


def plain_mix(docs, block=M.BLOCK, seed=M.SEED):
    """[(doc_id, size, source_size, target, taken)] of (doc_id, text, source) rows, one slot after the other."""
    rows = [(i, len(re.findall(r"[^\x20\x09-\x0D]+", t or "")), s, t) for i, t, s in docs]
    sizes, count = Counter(), Counter()
    for _, size, s, _ in rows:
        sizes[s] += size
        count[s] += 1
    target, names = targets(dict(sizes))
    lines, quota, blocks = {}, [], []
    for k, s in enumerate(names):
        buckets = ceil(sqrt(count[s]))
        own = [(spark_hash(("i", seed), i, size, t), (i is not None, i or 0), size, at) for at, (i, size, source, t) in enumerate(rows) if source == s and size]
        lines[k] = sorted(own, key=lambda r: (r[0] % buckets, *r[:3]))
        blocks.append(-(-sizes[s] // block))
        quota.append(min(2 * blocks[k], int(target[s] * blocks[k] / max(sizes[s], 1) + 0.5)))
    deck = [k for k, q in enumerate(quota) for _ in range(q)]
    got, spare, slots = Counter(), {k: [] for k in range(len(names))}, []
    for g in range(len(deck)):
        k = deck[spark_hash(("i", seed), g) % len(deck)]
        if got[k] < quota[k]:
            slots.append((k, got[k]))
        else:
            spare[k].append(g)
        got[k] += 1
    for k in range(len(names)):
        slots += [(k, j) for j in range(got[k], quota[k])]
    assert len(slots) == len(deck) and sum(map(len, spare.values())) == sum(max(q - got[k], 0) for k, q in enumerate(quota))
    times = Counter((k, permutation(seed, k, j // blocks[k], j % blocks[k], blocks[k])) for k, j in slots)
    taken = [0] * len(rows)
    for k in lines:
        start = 0
        for _, _, size, at in lines[k]:
            taken[at] = sum(times[k, w // block] for w in range(start, start + size))
            start += size
    return [(i, size, sizes[s], float(target[s]), taken[at]) for at, (i, size, s, _) in enumerate(rows)]


def same(got, want):
    key = lambda r: tuple((v is not None, v if v is not None else 0) for v in (r[0], r[1], r[2], r[4]))
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [(*r[:3], r[4]) for r in got] == [(*r[:3], r[4]) for r in want]
    assert all(abs(g[3] - w[3]) <= 1e-9 * max(1, w[3]) for g, w in zip(got, want, strict=True))


COLUMNS = ("doc_id", "size", "source_size", "target", "taken")


def test_query_is_the_plain_mix(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "source").collect()]
    same(M.op13_mix_sources(spark, SMALL).select(*COLUMNS).collect(), plain_mix(docs))


def test_odd_rows(odd, none):
    docs = [tuple(r) for r in odd.select("doc_id", "text", "source").collect()]
    same(M.mix(odd, block=16).documents.select(*COLUMNS).collect(), plain_mix(docs, 16))
    empty = M.mix(none)
    assert empty.documents.count() == empty.slots.count() == empty.pieces.count() == 0
    blank = M.mix(odd.filter("text is null or trim(text) = ''")).documents.collect()
    assert blank and all((r["size"], r["target"], r["taken"]) == (0, 0.0, 0) for r in blank)


def hot(spark):
    source = "if(id % 3 = 0, 'hot', if(id % 40 = 1, null, concat('s', id % 7)))"
    return spark.range(3000).selectExpr("id as doc_id", f"{source} as source", "repeat(concat('w', id, ' '), cast(id % 50 as int)) as text")


def test_targets_are_met_and_no_document_is_taken_too_often(spark):
    rows = M.mix(hot(spark)).documents.toPandas()
    sums = rows.fillna({"source": "null"}).groupby("source").agg(size=("size", "sum"), own=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"))
    assert (sums["size"] == sums["own"]).all() and (rows["taken"] <= 2 * rows["size"]).all() and len(rows) == 3000
    assert abs(sums["target"].sum() - 1.5 * sums["size"].sum()) < 1e-6
    assert ((sums["taken"] - sums["target"]).abs() <= M.BLOCK).all()
    want, _ = targets(dict(zip([None if s == "null" else s for s in sums.index], map(int, sums["size"]), strict=True)))
    assert all(abs(sums["target"]["null" if s is None else s] - t) < 1e-6 for s, t in want.items())


def test_partitions_change_nothing(spark):
    docs = hot(spark)
    assert as_rows(M.mix(docs.repartition(7)).documents.toPandas()) == as_rows(M.mix(docs.coalesce(1)).documents.toPandas())


def test_many_sources_without_broadcast(spark, monkeypatch):
    docs = hot(spark)
    want = as_rows(M.mix(docs).documents.toPandas())
    monkeypatch.setattr(M, "light", lambda df: False)
    assert as_rows(M.mix(docs).documents.toPandas()) == want


def test_slots_and_pieces(spark):
    """Slots are the mix: every one holds a block, and counts of a shard vary as a draw does; pieces give each block's words."""
    got = M.mix(hot(spark), block=16)
    slots, pieces = got.slots.toPandas().fillna({"source": "null"}), got.pieces.toPandas().fillna({"source": "null"})
    assert not slots.duplicated(["shard", "slot"]).any() and not slots.duplicated(["source", "pass", "block"]).any()
    words = pieces.groupby(["source", "block"])["words"].sum()
    assert words.max() == 16 and (words < 16).sum() <= slots["source"].nunique()
    assert int(slots.merge(words.reset_index(), on=["source", "block"])["words"].sum()) == got.documents.agg(F.sum("taken")).first()[0]
    shards = slots.groupby("shard").size()
    assert shards.iloc[:-1].nunique() == 1 and abs(len(shards) - isqrt(len(slots))) <= 2
    share = (slots["source"] == "hot").mean()
    counts = slots[slots["source"] == "hot"].groupby("shard").size()
    assert 0.5 < counts.iloc[:-1].var() / (shards.iloc[0] * share * (1 - share)) < 1.8


def test_permutations(spark):
    """Each n and pass has a bijection of its own, small and large."""
    sizes = [1, 2, 3, 5, 17, 64, 65, 1000, 4096, 4099, 5000]
    rows = spark.createDataFrame([(n, s, p) for n in sizes for s in (0, 3) for p in (0, 1)], "n long, s long, pass long")
    spread = rows.withColumn("v", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).withColumn("w", M.permuted(M.SEED))
    out = spread.groupBy("n", "s", "pass").agg(F.count_distinct("w").alias("d"), F.min("w").alias("low"), F.max("w").alias("high"), F.count_if(F.col("v") == F.col("w")).alias("fixed")).collect()
    assert all((r["d"], r["low"], r["high"]) == (r["n"], 0, r["n"] - 1) for r in out)
    assert all(r["fixed"] < 20 for r in out if r["n"] >= 1000)


def test_plan_is_native(spark, odd):
    got = M.mix(odd)
    plan = "".join(df._jdf.queryExecution().toString() for df in (got.documents, got.slots, got.pieces))
    assert "Python" not in plan and "Arrow" not in plan
