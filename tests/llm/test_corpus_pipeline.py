from fractions import Fraction

import corpus_pipeline
from brute import held_items, jaccard_join, readings
from helpers import SMALL

from millrace.llm import catalog, language_id
from millrace.runtime import table


def test_pipeline_is_the_plain_one(spark):
    docs = {r["doc_id"]: r["text"] for r in table(spark, SMALL, "documents").collect()}
    items = [(r["item_id"], r["text"]) for r in table(spark, SMALL, "benchmark").collect()]
    rows = table(spark, SMALL, "documents")
    samples = language_id.sample(rows.filter(~language_id.held_out(rows.doc_id)))
    parsed = dict(zip(docs, readings([(t or "")[:400] for t in docs.values()], samples), strict=True))  # enough to tell a language from none
    stay = {i: t for i, t in docs.items() if t and any(c.isalpha() for c in t) and any(size >= 2 * (n - blocks) for blocks, size, counts in [parsed[i]] for n in counts)}
    assert len(stay) < len(docs) or all(any(c.isalpha() for c in t or "") for t in docs.values())
    last = {}
    for i, t in stay.items():
        last[t] = max(i, last.get(t, -1))
    rows = sorted((i, t) for t, i in last.items())
    near = jaccard_join(rows, 5, Fraction(4, 5))
    rows = [rows[k] for k, (size, first, _) in near.items() if not size or rows[k][0] == first]
    gone = {d for d, _ in held_items(rows, items)}
    want = {i for i, _ in rows} - gone
    got = catalog.pipeline(spark, SMALL)
    assert {r["doc_id"] for r in got.collect()} == want
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_stages_keep_the_columns(spark, tmp_path):
    docs = table(spark, SMALL, "documents").limit(60)
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SMALL)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns, name
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    assert docs.count() > 0 and corpus_pipeline.ORACLE_SQL is None


def test_all_operators_are_registered():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
