import math
import random

import numpy as np
from brute import readings
from helpers import SMALL

from millrace.llm import language_id as L
from millrace.runtime import table


def test_held_out_accuracy(spark):
    got = L.op1_language_id(spark, SMALL).join(table(spark, SMALL, "documents").select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(got) > 20 and sum(r["lang_pred"] == r["lang"] for r in got) / len(got) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got)


def longest(text, reference):
    phrases = at = 0
    while at < len(text):
        end = at
        while end < len(text) and text[at : end + 1] in reference:
            end += 1
        at, phrases = max(end, at + 1), phrases + 1
    return phrases


def test_automaton_reads_longest_matches():
    rng = random.Random(1)
    samples = [(lang, "".join(rng.choices(letters, k=400))) for lang, letters in (("a", "abcd "), ("b", "abce "))]
    parser = L.Parser(samples)
    for _ in range(40):
        text = "".join(rng.choices("abcde ", k=rng.randint(1, 80)))
        text = " ".join(text.split()) or "a"
        codes = parser.symbol[np.array([ord(c) for c in text])]
        got = parser.phrases(codes, np.array([0]), np.array([len(codes)]))[:, 0]
        for k, (_, reference) in enumerate(samples):
            squeezed = " ".join(reference.split(" ")) if "  " not in reference else __import__("re").sub(" +", " ", reference)
            assert got[k] == longest(text, squeezed)


def test_query_is_the_plain_one(spark):
    """Whole texts of several blocks too, by searching each phrase in the labelled text."""
    docs = table(spark, SMALL, "documents")
    samples = L.sample(docs.filter(~L.held_out(docs.doc_id)))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {r["doc_id"]: r for r in L.op1_language_id(spark, SMALL).collect()}
    assert set(got) == set(texts)
    chosen = sorted(texts, key=lambda i: -len(texts[i] or ""))[:3] + sorted(texts)[:30]
    assert len(texts[chosen[0]]) > 3 * L.BLOCK
    for i, (blocks, size, counts) in zip(chosen, readings([texts[i] for i in chosen], samples), strict=True):
        if not any(c.isalpha() for c in texts[i] or ""):
            assert got[i]["lang_pred"] == "und"
            continue
        sizes = [len(L.squeeze(c, np.zeros(len(c), bool))[0][: L.SYMBOLS]) for c in (L.Parser(samples).symbol[[ord(x) for x in t]] for _, t in samples)]
        cost = [n * math.log2(m) / size for n, m in zip(counts, sizes, strict=True)]
        best = min(range(len(cost)), key=lambda k: (cost[k], k))
        assert got[i]["lang_pred"] == samples[best][0]
        low, second = sorted(cost)[:2]
        assert abs(got[i]["score"] - second / (low + second)) < 1e-9 and abs(got[i]["phrase_length"] - size / max(counts[best] - blocks, 0.5)) < 1e-9


def test_foreign_texts_go(spark):
    rng = random.Random(4)
    docs = table(spark, SMALL, "documents")
    samples = L.sample(docs)
    foreign = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=900)), "漢字仮名交じり文" * 60, "кириллица и другие " * 40, "qzxj wvkq xzjq " * 30]
    rows = spark.createDataFrame([(k, t, "en") for k, t in enumerate(foreign)], "doc_id long, text string, lang string")
    assert L.predict(rows, samples).filter(f"phrase_length >= {L.SHORTEST}").count() == 0
    both = docs.select("doc_id", "text", "lang").filter("text is not null").union(rows.selectExpr("doc_id + 10000000 as doc_id", "text", "cast(null as string) as lang"))
    kept = {r["doc_id"] for r in L.keep(both).collect()}
    assert kept == {r["doc_id"] for r in docs.collect() if any(c.isalpha() for c in r["text"] or "")}
    only = L.keep(both, languages={"de"})
    assert {r["lang"] for r in only.collect()} == {"de"} and only.count() == docs.filter("lang = 'de'").count()


def test_odd_rows(spark, odd, none):
    docs = odd.union(spark.createDataFrame([(20, "the house is big and the dog is old", "en", "s", 1, "", 1, b""), (21, "la casa es grande y el perro es viejo", "es", "s", 1, "", 1, b"")], odd.schema))
    samples = L.sample(docs)
    got = {r["doc_id"]: r for r in L.predict(docs, samples).collect()}
    assert got[1]["lang_pred"] == got[2]["lang_pred"] == got[3]["lang_pred"] == got[4]["lang_pred"] == "und" and got[4]["score"] == 0
    assert got[20]["lang_pred"] == "en" and got[9]["lang_pred"] in ("en", "es")
    kept = L.keep(docs)
    assert kept.columns == docs.columns and {1, 2, 3, 4}.isdisjoint(r["doc_id"] for r in kept.collect())
    learned = L.sample(docs.filter(~L.held_out(docs.doc_id)))
    assert kept.count() == L.predict(docs, learned).filter(f"phrase_length >= {L.SHORTEST}").count() > 8
    assert L.predict(none, samples).count() == 0
    assert {r["lang_pred"] for r in L.predict(docs, []).collect()} == {"und"}


def test_labels_are_no_input(spark):
    docs = table(spark, SMALL, "documents").limit(50)
    samples = L.sample(table(spark, SMALL, "documents"))
    plain = L.predict(docs, samples).collect()
    shifted = L.predict(docs.selectExpr("doc_id + 1000000 as doc_id", "text", "'xx' as lang"), samples).collect()
    assert sorted((r[0] + 1000000, *r[1:]) for r in plain) == sorted(tuple(r) for r in shifted)


def test_languages_of_many_copies_are_learned(spark):
    rows = [(f"l{k:02d}", f"{chr(97 + k)} text of language {k}") for k in range(26) for _ in range(500)] + [("l00", f"another text {i}") for i in range(200)]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    got = dict(L.sample(docs))
    assert sorted(got) == [f"l{k:02d}" for k in range(26)] and got["l07"] == "h text of language 7"
    assert len(got["l00"].split("\n")) == L.DOCS == len(set(got["l00"].split("\n")))
    assert L.sample(docs.union(docs).repartition(5)) == sorted(got.items())


def test_all_sampled_documents_take_part(spark):
    texts = [f"{i:02d}" + "x" * (3 * L.SYMBOLS if i % 2 else 5) for i in range(L.DOCS)]
    ((_, text),) = L.sample(spark.createDataFrame([("en", t) for t in texts], "lang string, text string"))
    assert 0.99 * L.SYMBOLS < len(text) <= L.SYMBOLS and sorted(x[:2] for x in text.split("\n")) == sorted(t[:2] for t in texts)
