from helpers import SMALL, as_rows, duck
from pyspark.sql import functions as F

from millrace.llm import exact_dedup as X


def test_query_is_its_sql(spark):
    got = X.op8_exact_dedup(spark, SMALL).toPandas()
    assert as_rows(got) == as_rows(duck(SMALL).execute(X.ORACLE).df())


def test_odd_rows(odd, none):
    got = [r.asDict() for r in X.decide(odd).collect()]
    assert len(got) == odd.count() and X.decide(none).count() == 0 and X.keep(none).count() == 0
    empty = [r for r in got if r["doc_id"] in (1, 2)]
    assert {r["keep_id"] for r in empty} == {2} and {r["group_size"] for r in empty} == {3}
    ones = sorted((r["doc_id"], r["kept"]) for r in got if r["doc_id"] in (5, 6))
    assert ones == [(5, False), (5, False), (6, True)]
    assert X.keep(odd).columns == odd.columns
    assert X.keep(odd).count() == sum(r["kept"] for r in got) == odd.select(F.coalesce("text", F.lit(""))).distinct().count()


def test_repeated_id_and_text_leaves_one(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (None, "c"), (None, "c")], "doc_id long, text string")
    assert sorted((str(r["doc_id"]), r["kept"]) for r in X.decide(rows).collect()) == [("1", False), ("1", True), ("2", True), ("None", False), ("None", True)]


def test_texts_with_one_digest_stay_apart(spark):
    """Full texts are compared at every stage: a digest that tells nothing changes nothing."""
    rows = spark.createDataFrame([(i, f"t{i % 7}") for i in range(100)], "doc_id long, text string")
    blind = lambda c: F.unhex(F.lit("00"))
    assert as_rows(X.decide(rows, digest=blind).toPandas()) == as_rows(X.decide(rows).toPandas())
    assert sorted(r["doc_id"] for r in X.keep(rows, digest=blind).collect()) == list(range(93, 100))


def test_plan_is_native(spark, odd):
    plan = X.decide(odd)._jdf.queryExecution().toString() + X.keep(odd)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_ids_of_any_type(spark):
    rows = spark.createDataFrame([("a", "x"), ("b", "x"), (None, "x"), ("c", "y"), (None, "z")], "doc_id string, text string")
    assert sorted((str(r["doc_id"]), r["text"]) for r in X.keep(rows).collect()) == [("None", "z"), ("b", "x"), ("c", "y")]
    assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["kept"]) for r in X.decide(rows).collect()) == [
        ("None", "None", 1, True), ("None", "b", 3, False), ("a", "b", 3, False), ("b", "b", 3, True), ("c", "c", 1, True)]
    dates = rows.selectExpr("if(text = 'y', null, date'2020-01-01') as doc_id", "text")
    assert X.keep(dates).count() == 3


def test_a_third_in_one_group(spark):
    rows = spark.range(6000).selectExpr("id as doc_id", "if(id % 3 = 0, 'hot', concat('t', id div 2)) as text")
    got = X.decide(rows)
    assert got.filter("text_sha256 = sha2('hot', 256)").selectExpr("min(keep_id)", "max(keep_id)", "min(group_size)", "count_if(kept)", "count(*)").first() == (5997, 5997, 2000, 1, 2000)
    assert got.filter("kept").count() == rows.select("text").distinct().count() == X.keep(rows).count()
