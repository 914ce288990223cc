import pytest
from brute import held_items
from helpers import SMALL, as_rows, duck

from millrace.llm import decontaminate as D


def test_query_is_its_sql(spark):
    got = D.op3_decontaminate(spark, SMALL).toPandas()
    assert as_rows(got) == as_rows(duck(SMALL).execute(D.ORACLE).df())


ITEM = "the quick brown fox jumps over the lazy dog while seven wizards quietly brew"
FILL = " ".join(f"w{i}" for i in range(400))


@pytest.mark.parametrize("text,held", [
    (f"{FILL} {ITEM} {FILL}", True), (f"{FILL} {ITEM.upper()}!! {FILL}", True), (ITEM.replace(" ", "\n"), True), (FILL, False),
    (f"{FILL} {ITEM[:30]} {FILL}", False), (ITEM.replace("wizards", "witches"), False), (ITEM + " wizards", True),
])
def test_containment(spark, text, held):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    items = spark.createDataFrame([(7, ITEM), (8, "short one"), (9, None), (10, "")], "item_id long, text string")
    assert [(r["doc_id"], r["item_id"]) for r in D.find(docs, items).collect()] == ([(1, 7)] if held else [])
    assert D.keep(docs, items).count() == (0 if held else 1)


def test_is_exhaustive(spark):
    import random

    rng = random.Random(3)
    vocabulary = [f"v{i}" for i in range(40)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([3, 6, 20, 60])))) for i in range(30)]
    docs = []
    for d in range(120):
        w = rng.choices(vocabulary, k=rng.choice([3, 50, 300]))
        piece = items[d % 30][1].split()
        if rng.random() < 0.7:
            piece = [x if rng.random() < 0.97 else "zz" for x in piece]
            w[len(w) // 2 : len(w) // 2] = piece
        docs.append((d, " ".join(w)))
    docs += [(200, items[0][1]), (201, items[1][1])]
    got = D.find(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]): r["containment"] for r in got.collect()} == held_items(docs, items)


def test_odd_rows(spark, odd, none):
    items = odd.selectExpr("doc_id as item_id", "text")
    got = {(r["doc_id"], r["item_id"]) for r in D.find(odd, items).collect()}
    assert {(5, 5), (5, 6), (6, 5), (7, 7), (None, 7), (7, None), (10, 10)} <= got and not any(1 in p or 2 in p for p in got)
    kept = D.keep(odd, items)
    assert kept.columns == odd.columns and sorted(r["doc_id"] for r in kept.filter("doc_id is not null").collect()) == [1, 2, 3]
    assert D.find(none, items).count() == 0 and D.find(odd, items.limit(0)).count() == 0 and D.keep(odd, items.limit(0)).count() == odd.count()


def test_same_id_is_judged_by_row(spark):
    docs = spark.createDataFrame([(1, ITEM), (1, FILL), (None, FILL), (None, ITEM)], "doc_id long, text string")
    items = spark.createDataFrame([(7, ITEM)], "item_id long, text string")
    assert sorted(str(r["doc_id"]) for r in D.keep(docs, items).collect()) == ["1", "None"]
    assert D.keep(docs, items).filter(docs.text == ITEM).count() == 0


def test_plan_is_native(spark, odd):
    plan = D.keep(odd, odd.selectExpr("doc_id as item_id", "text"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_each_size_partition_is_probed_by_its_bounds(spark):
    rows = spark.createDataFrame([(1, 0, " ".join(f"w{i}" for i in range(12))), (2, 0, FILL)], "_id long, _hash long, _text string")
    got = D.probes(rows, [(3, 0, 8 * 0.8), (5, 2**61, 32 * 0.8)]).collect()
    every = {r["_id"]: r["h"] for r in rows.select("_id", D.hashes(rows["_text"]).alias("h")).collect()}
    want = [(1, 3, h) for h in every[1] if h <= 0] + [(2, 3, h) for h in every[2] if h <= 0] + [(2, 5, h) for h in every[2] if h <= 2**61]
    assert sorted((r["_id"], r["part"], r["hash"]) for r in got) == sorted(want)


def test_windows_are_compiled_and_texts_split_once(spark):
    rows = spark.createDataFrame([(i, 0, t) for i, t in enumerate([FILL, ITEM, "a b c d e", "a b", "...", "", None])], "_id long, _hash long, _text string")
    probes = D.probes(rows, [(3, 2**63 - 1, 1.0)])
    plan = probes._jdf.queryExecution().executedPlan().toString()
    assert "lambda" not in plan and plan.count("split(") == 1
    want = [(r["_id"], h) for r in rows.select("_id", D.hashes(rows["_text"]).alias("h")).collect() for h in r["h"]]
    assert sorted((r["_id"], r["hash"]) for r in probes.collect()) == sorted(want)


def test_items_of_one_text_are_searched_once(spark):
    docs = spark.createDataFrame([(i, f"{FILL} {ITEM}" if i < 3 else FILL) for i in range(6)], "doc_id long, text string")
    items = spark.createDataFrame([(i, ITEM) for i in range(40)] + [(40, ITEM.upper()), (41, None)], "item_id long, text string")
    assert sorted((r["doc_id"], r["item_id"]) for r in D.find(docs, items).collect()) == [(d, i) for d in range(3) for i in range(41)]
    assert D._held(docs, items, "doc_id", "text", "text", D.WORDS, D.SHARE).count() == 3 * 2 and D.keep(docs, items).count() == 3
