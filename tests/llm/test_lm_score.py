import math
import random
from collections import Counter

import pytest
from helpers import SMALL

from millrace.llm import lm_score as M
from millrace.runtime import table

DOCS = [(1, "good words make good text"), (2, "good text reads well"), (3, "junk buy now junk buy now"), (4, "buy junk"), (5, None), (6, ""), (7, "good words")]


def test_scores_are_those_of_the_plain_model(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in M.score(docs, spark.createDataFrame([(1,), (2,), (2,), (None,)], "doc_id long")).collect()}

    def counted(ids):
        single, pair = Counter(), Counter()
        for i, t in DOCS:
            if i in ids and t:
                w = t.split()
                single.update(w)
                pair.update(zip([None, *w], w))
        return single, pair

    def loss(name, me, text):
        tables = {"t": counted({1, 2} - {me}), "b": counted({i for i, _ in DOCS} - {me})}
        n_t, n_b = sum(tables["t"][0].values()), sum(tables["b"][0].values())
        scale = 1.0 if name == "t" else n_t / n_b
        single, pair = tables[name]
        w, total = text.split(), 0.0
        for before, word in zip([None, *w], w):
            p1 = (single[word] * scale + M.ALPHA) / (n_t + M.ALPHA * len({w for _, t in DOCS for w in (t or "").split()}))
            total -= math.log((pair[before, word] * scale + M.MU * p1) / (single[before] * scale + M.MU))
        return total / len(w)

    for i, t in DOCS:
        if t:
            assert got[i]["target_loss"] == pytest.approx(loss("t", i, t), rel=1e-9)
            assert got[i]["score"] == pytest.approx(loss("t", i, t) - loss("b", i, t), rel=1e-6, abs=1e-9)
        else:
            assert got[i]["n_tokens"] == 0 and got[i]["score"] is None
    assert got[7]["score"] < got[4]["score"]


def test_query_tells_target_from_rest(spark):
    """Of the language that most documents are in, as a language of few has too little text for a model that leaves the document out."""
    base = SMALL.replace("sf0.001", "sf0.01")
    english = table(spark, base, "documents").filter("lang = 'en'").select("doc_id")
    got = M.op10_lm_score(spark, base).join(table(spark, base, "labels"), "doc_id").join(english, "doc_id").filter("score is not null").collect()
    mean = lambda q: sum(r["score"] for r in got if r["quality"] == q) / max(1, sum(r["quality"] == q for r in got))
    assert mean(1) < mean(0) - 0.3


def test_odd_rows(odd, none):
    ids = odd.select("doc_id")
    assert M.score(odd, ids).count() == odd.count() and M.score(none, ids).count() == 0
    assert all(r["score"] is None for r in M.score(odd, ids.limit(0)).collect())


def test_more_tasks_same_counts(spark, monkeypatch):
    monkeypatch.setattr(M, "FAN", 2)
    docs = spark.createDataFrame([(i % 2 == 0, f"a b c{i % 5}") for i in range(200)], "t boolean, text string")
    a, b = M.counts(docs.repartition(9), "t", "text"), M.counts(docs.coalesce(1), "t", "text")
    assert (a[0] == b[0]).all() and (a[1] == b[1]).all() and a[1][:7].sum() == 600


def test_many_small_blocks_give_the_plain_model(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK", 500)
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices([f"w{k}" for k in range(400)], k=rng.randint(1, 60)))) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r for r in M.score(docs, spark.createDataFrame([(i,) for i in range(40)], "doc_id long")).collect()}
    single, pair = [Counter(), Counter()], [Counter(), Counter()]
    for i, t in rows:
        for k in (0, 1) if i < 40 else (1,):
            single[k].update(t.split())
            pair[k].update(zip([None, *t.split()], t.split()))
    n, size = [sum(s.values()) for s in single], len(single[1])
    assert len(pair[1]) > 2000 and size > 300
    for i, t in rows:
        w, want = t.split(), []
        mine = Counter(w), Counter(zip([None, *w], w))
        n_t, n_b = n[0] - len(w) * (i < 40), n[1] - len(w)
        for k, scale in ((0, 1.0), (1, n_t / n_b)):
            loss, out = 0.0, k or i < 40
            for before, word in zip([None, *w], w):
                one, two, last = single[k][word] - out * mine[0][word], pair[k][before, word] - out * mine[1][before, word], single[k][before] - out * mine[0][before]
                p1 = (one * scale + M.ALPHA) / (n_t + M.ALPHA * size)
                loss -= math.log((two * scale + M.MU * p1) / (last * scale + M.MU))
            want.append(loss / len(w))
        assert [got[i]["target_loss"], got[i]["background_loss"]] == pytest.approx(want, rel=1e-9)


def test_questions_grow_no_faster_than_the_input(spark, monkeypatch):
    """Rows between blocks and slabs: not blocks times slabs, which would be sixteen times as many for four times the text."""
    for name, value in (("BLOCK", 40), ("LEAST", 1), ("FAN", 1)):
        monkeypatch.setattr(M, name, value)
    rows = {}
    for n in (1000, 4000):
        docs = spark.range(n).selectExpr("id % 2 = 0 as t", "concat('a b c', id, ' d', id % 7, ' e', id % 900) as text")
        dealt, slabs = M.dealt(docs, "t", "text", "text")
        rows[n] = M.asked(dealt, slabs).count(), slabs
        assert rows[n][0] <= n * 9  # n-grams of all texts
    assert rows[4000][1] >= 3.9 * rows[1000][1] and rows[4000][0] <= 4.4 * rows[1000][0]


def test_totals(spark):
    docs = spark.createDataFrame([(True, "a b a"), (False, "b c"), (False, None), (True, " ")], "_target boolean, _text string")
    assert M.totals(docs) == (3, 5, 3) and M.totals(docs.limit(0)) == (0, 0, 0)
