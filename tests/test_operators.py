import statistics

import pytest
from pyspark.sql import functions as F

from millrace.functions import hashing
from millrace.operators import clean, constraints, dedupe, enrich, lineage, profile, report, shape, vectors
from millrace.plans import pipeline

CUSTOMERS = [(1, "John Doe", "john@example.com", "active"), (2, "Jane Smith", "jane@example.com", "inactive"), (3, "John Doe", "john@example.com", "active"), (4, "Bob Jones", None, "active"), (5, "Alice Brown", "alice@example.com", "pending"), (6, "John  Doe", "john@example.com", "active")]
SCHEMA = "id long, name string, email string, status string"


@pytest.fixture
def rows(spark):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(CUSTOMERS)], f"row_id long, {SCHEMA}")


@pytest.mark.parametrize("parts", [1, 4, 17])
def test_keep_first_whatever_the_partitions(rows, parts):
    kept = dedupe.keep_first(rows.repartition(parts), hashing.content_hash(rows.drop("row_id")), "row_id")
    assert sorted(r["row_id"] for r in kept.collect()) == [0, 1, 3, 4, 5]


def test_new_rows(spark, rows):
    key = hashing.content_hash(rows.drop("row_id"))
    state = spark.createDataFrame([], "row_hash string, first_seen_row long")
    fresh, add = dedupe.new_rows(rows, state, key, "row_id")
    assert fresh.count() == 5
    assert dedupe.new_rows(rows, add, key, "row_id")[0].count() == 0


@pytest.mark.parametrize("parts", [1, 7])
def test_reservoir_is_deterministic(spark, parts):
    df = spark.range(500).withColumn("x", F.col("id") * 2).repartition(parts)
    got = sorted(r["row_id"] for r in profile.reservoir(df, ["x"], "id", 20).collect())
    import hashlib

    want = sorted(range(500), key=lambda i: hashlib.sha256(f"x_v1|{i}".encode()).hexdigest()[:16])[:20]
    assert got == sorted(want)


def test_profile(spark):
    data = [(i, str(i) if i % 3 else "oops", None if i % 4 == 0 else float(i), ["b", "a", "b ", "B"][i % 4]) for i in range(40)]
    df = spark.createDataFrame(data, "row_id long, s string, x double, c string")
    stats = profile.as_dict(profile.profile(df, "row_id", 1, 1))
    assert stats["s"]["is_numeric"] and stats["x"]["is_numeric"] and not stats["c"]["is_numeric"]
    assert stats["x"]["median"] == statistics.median(v for _, _, v, _ in data if v is not None)
    assert stats["c"]["mode"] == "b" and stats["c"]["median"] is None


def test_mode_ties(spark):
    df = spark.createDataFrame([(0, "z"), (1, "a"), (2, "a"), (3, "z")], "i long, v string")
    assert profile.modes_first_seen(df, ["v"], "i", 1).first()["mode"] == "z"
    assert profile.modes_lowest(profile.reservoir(df, ["v"], "i")).first()["mode"] == "a"


def test_impute_orders_and_flags(spark):
    df = spark.createDataFrame([(1, None, None), (2, 3.0, ""), (3, 5.0, "q")], "id long, x double, s string")
    stats = {"x": {"median": 4.0, "mode": "3.0"}, "s": {"mode": "m"}}
    a = {r["id"]: r for r in clean.impute(df, stats).collect()}
    assert a[1]["x"] == 4.0 and a[1]["s"] == "m" and a[2]["s"] == "" and a[1]["x_was_imputed"] and not a[2]["s_was_imputed"]
    b = {r["id"]: r for r in clean.impute(df, stats, ("mode", "median"), empty_is_missing=True).collect()}
    assert b[1]["x"] == 3.0 and b[2]["s"] == "m"


def test_outliers(spark):
    df = spark.createDataFrame([(i, float(v), 1.0) for i, v in enumerate([1, 2, 2, 3, 3, 3, 4, 99])] + [(8, None, None)], "i long, v double, flat double")
    flagged = clean.outlier_flags(df, ["v", "flat"])
    assert [r["i"] for r in flagged.filter("v_is_outlier").collect()] == [7]
    assert flagged.filter("flat_is_outlier").count() == 0
    assert clean.drop_outliers(flagged).count() == 8


@pytest.mark.parametrize("make", [lambda i: i, lambda i: i % 7, lambda i: 5.0 if i < 1500 else 6.0, lambda i: -(i * i % 997) / 3, lambda i: 1e300 if i % 3 == 0 else float(i), lambda i: None if i % 2 else float("nan") if i % 10 == 0 else i])
@pytest.mark.parametrize("room", [10, 100, 10_000])
def test_quantiles_are_exact_in_any_room(spark, make, room):
    import numpy as np

    values = [make(i) for i in range(3000)]
    df = spark.createDataFrame([(i, None if v is None else float(v), v is not None) for i, v in enumerate(values)], "i long, v double, w boolean").repartition(5)
    real = np.array([v for v in values if v is not None and v == v], float)
    want = np.quantile(real, [0, 0.25, 0.4999, 0.5, 0.75, 1])
    assert profile.quantiles(df, ["v"], [0, 0.25, 0.4999, 0.5, 0.75, 1], room)["v"] == pytest.approx(list(want), rel=1e-12)
    assert profile.quantiles(df.limit(0), ["v"], [0.5], room) == {"v": [None]}


def test_reservoir_is_bounded_before_it_is_ranked(spark):
    df = spark.range(20_000).withColumn("x", F.col("id") * 2).withColumn("few", F.when(F.col("id") < 30, F.col("id")))
    sample = profile.reservoir(df, ["x", "few"], "id", 50)
    import hashlib

    want = sorted(range(20_000), key=lambda i: hashlib.sha256(f"x_v1|{i}".encode()).hexdigest()[:16])[:50]
    got = sample.collect()
    assert sorted(r["row_id"] for r in got if r["column"] == "x") == sorted(want) and sum(r["column"] == "few" for r in got) == 30


def test_impute_widens_whole_numbers(spark):
    df = spark.createDataFrame([(1, None), (2, 1), (3, 2)], "id long, n int")
    out = clean.impute(df, {"n": {"median": 1.5, "mode": None}})
    assert dict(out.dtypes)["n"] == "double" and [r["n"] for r in out.orderBy("id").collect()] == [1.5, 1.0, 2.0]
    assert dict(clean.impute(df, {"n": {"median": 2.0, "mode": "1"}}).dtypes)["n"] == "int"


def test_fallback_statistics(spark):
    df = spark.createDataFrame([(0, None, None, None), (1, 3.0, "b", None), (2, 5.0, "a", None), (3, None, None, None)], "row_id long, x double, s string, z string")
    stats = profile.fallbacks(df, {"x": {"median": None, "mode": None}}, "row_id")
    assert stats["x"]["median"] == 4.0 and stats["s"]["mode"] == "a" and stats["z"]["mode"] is None
    assert profile.fallbacks(df, {c: {"median": None, "mode": "m"} for c in "xsz"}, "row_id") == {c: {"median": None, "mode": "m"} for c in "xsz"}


def test_merge_categories_in_one_job(spark):
    df = spark.createDataFrame([(0, "active", "x1"), (1, "activee", "x2"), (2, "pending", "x3")], "i long, c string, d string").withColumn("many", F.concat(F.lit("value"), F.col("i")))
    wide = spark.range(600).selectExpr("id as i", "concat('v', id) as c")
    jobs = lambda: len(spark.sparkContext.statusTracker().getJobIdsForGroup("merge"))
    spark.sparkContext.setJobGroup("merge", "")
    aliases = clean.category_aliases(df, ["c", "d", "many"], "i")
    assert aliases["c"]["activee"] == "active" and jobs() <= 3  # the parts of one adaptive plan
    spark.sparkContext.setJobGroup("other", "")
    assert clean.category_aliases(wide, ["c"], "i") == {} and clean.category_aliases(df, [], "i") == {}


def test_lineage_needs_no_join(spark, rows):
    result = pipeline.clean_worker(rows)
    plan = result.changes._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "InMemoryTableScan" in plan
    result.release()


def test_fast_signatures(spark):
    words = lambda i: f"a row of words about the subject number {i}"
    df = spark.createDataFrame([(i, words(i // 2) + "!" * (i % 2)) for i in range(200)], "id long, s string")
    near = lambda family: {(r["row_id"], r["candidate_id"]) for r in dedupe.near_duplicates(df, F.col("s"), "id", threshold=0.9, how="jaccard", every=2, family=family).collect()}
    twins = {(i + 1, i) for i in range(0, 200, 2)}
    assert len(twins & near("xxhash64")) > 95 and len(twins & near("sha256")) > 95
    with pytest.raises(ValueError):
        hashing.minhash(F.col("s"), family="md5")


def test_short_texts_meet_their_equals(spark):
    df = spark.createDataFrame([(0, "ab"), (1, "cd"), (2, "ab"), (50, "ab"), (3, None), (4, "a longer text of words"), (100, "a longer text of words!")], "id long, s string")
    pairs = {(r["row_id"], r["candidate_id"]) for r in dedupe.near_candidates(df, F.col("s"), "id").collect()}
    assert {(2, 0), (50, 0), (0, 50), (2, 50), (4, 100)} <= pairs and not any(1 in p or 3 in p for p in pairs)
    samples = dedupe.lsh_samples(df, F.col("s"), "id")
    assert {(r["row_id"], r["candidate_id"]) for r in dedupe.near_candidates(df, F.col("s"), "id", samples).collect()} == pairs


@pytest.mark.parametrize("text", [" " * 1_000_000, "a" + " " * 1_000_000 + "b", "x" * 1_000_000, "." * 1_000_000 + "a", "a." * 500_000 + "@", "a" + "!" * 1_000_000 + "b"])
def test_long_cells_take_linear_time(spark, text):
    import time

    from millrace.functions import privacy
    from millrace.functions import text as T

    df = spark.createDataFrame([(text,)], "s string").cache()
    df.count()
    began = time.time()
    df.select(T.strip(F.col("s")), T.clean_text(F.col("s")), privacy.redact(F.col("s"))).write.format("noop").mode("overwrite").save()
    assert time.time() - began < 5


def test_merge_categories(spark):
    df = spark.createDataFrame([(0, "active"), (1, "activee"), (2, "pending"), (3, None)], "i long, c string")
    assert [r["c"] for r in clean.merge_categories(df, ["c"], "i").orderBy("i").collect()] == ["active", "active", "pending", None]


def test_lineage(spark):
    old = spark.createDataFrame([(0, "A", None), (1, "b", 2)], "row_id long, s string, n int")
    new = spark.createDataFrame([(0, "a", 7), (1, "b", 2)], "row_id long, s string, n int")
    got = {(r["row_id"], r["column_name"]): r["kind"] for r in lineage.changes(old, new, "row_id").collect()}
    assert got == {(0, "s"): "normalization", (0, "n"): "imputation"}
    assert lineage.needs_review(lineage.provenance(old, new, "row_id"), 0.5, 0.95).count() == 1


def test_shape(spark):
    df = spark.createDataFrame([((1, ("x",)), [1, 2])], "a struct<b:int,c:struct<d:string>>, l array<int>")
    flat = shape.flatten(df)
    assert flat.columns == ["a.b", "a.c.d", "l"] and tuple(flat.first()) == (1, "x", "[1,2]")
    assert shape.align(df, ["z", "l"]).columns == ["z", "l"]
    assert [r["row_id"] for r in shape.with_row_id(spark.range(5).repartition(1)).collect()] == list(range(5))


def test_constraints(spark):
    df = spark.createDataFrame([(1, -1.0, "a"), (1, 2.0, "b"), (2, None, "z")], "k long, x double, c string")
    got = {(r["rule"], r["column"]): r["violations"] for r in constraints.violations(df, [("non_negative", "x"), ("one_of", "c", ["a", "b"]), ("not_null", "x"), ("unique", "k")]).collect()}
    assert got == {("non_negative", "x"): 1, ("one_of", "c"): 1, ("not_null", "x"): 1, ("unique", "k"): 1}
    drifted = constraints.drift(df, df.withColumn("x", F.col("x") * 3), ["x", "k"])
    assert {r["column"]: r["drifted"] for r in drifted.collect()} == {"x": True, "k": False}


def test_vectors(spark):
    df = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(20)], "vec_id long, embedding array<float>")
    near = vectors.nearest(df, df.filter("vec_id = 5"), 3).orderBy("rank").collect()
    assert [(r["vec_id"], r["distance"]) for r in near] == [(4, 1.0), (6, 1.0), (3, 2.0)]
    assert vectors.nearest(df, df.filter("vec_id < 0"), 3).count() == 0
    named = df.withColumn("vec_id", F.format_string("v%02d", "vec_id"))
    assert [r["vec_id"] for r in vectors.nearest(named, named.filter("vec_id = 'v05'"), 3).orderBy("rank").collect()] == ["v04", "v06", "v03"]
    assert {r["vec_id"] for r in vectors.nearest_approximate(df, df.filter("vec_id = 5"), 2).collect()} <= {3, 4, 6, 7}
    assert vectors.nearest_approximate(df.limit(0), df.limit(0)).count() == 0


def test_enrich(spark):
    df = spark.createDataFrame([("a b",), ("a b",), (None,)], "s string")
    got = enrich.enrich(df, ["s"]).collect()
    assert [r["s__token_count"] for r in got] == [2, 2, 0] and got[2]["s__suggested_canonical"] == "a b"
    assert enrich.analyse(df, None) is df


def test_full_pipeline(spark, rows):
    result = pipeline.clean_table(rows.withColumn("score", F.when(F.col("id") != 4, F.col("id") * 1.5)))
    out = {r["row_id"]: r for r in result.cleaned.collect()}
    assert out[3]["score_was_imputed"] and out[0]["name"] == "john doe" and len(out) == 6
    doc = pipeline.report_of(result)
    assert doc["summary"]["original_row_count"] == 6 and set(doc) >= {"summary", "schema", "cleaning_details"}


def test_worker_pipeline(spark, rows):
    result = pipeline.clean_worker(rows)
    stats = lineage.worker_stats(rows, result.cleaned, result.changes, result.scores).first()
    assert stats["rows_kept"] == 5 and stats["rows_dropped"] == 1 and stats["deduplication_rate"] > 0.8
    assert stats["imputations"] == 1 and result.cleaned.columns == rows.columns
    again = pipeline.clean_worker(rows.repartition(5))
    assert sorted(map(str, again.cleaned.collect())) == sorted(map(str, result.cleaned.collect()))


def test_worker_fills_by_all_rows(spark):
    """One value is more frequent by a single row, and the median lies between two values, in more rows than a reservoir holds."""
    n = 2 * profile.CAPACITY + 1
    df = spark.range(n).selectExpr("id as row_id", f"if(id < {n // 2 + 1}, 'zebra', 'ant') as kind", f"if(id < {n // 2 + 1}, 1.0d, id * 1.0d) as value")
    stats = pipeline.clean_worker(df).stats
    assert stats["kind"]["mode"] == "zebra" and stats["value"]["median"] == 1.0
    turned = df.withColumn("kind", F.when(F.col("kind") == "ant", "zebra").when(F.col("row_id") > 0, "ant")).withColumn("value", F.col("row_id") * 1.0)
    stats = pipeline.clean_worker(turned).stats
    assert stats["kind"]["mode"] == "ant" and stats["value"]["median"] == profile.CAPACITY


def test_empty_input(spark, rows):
    result = pipeline.clean_table(rows.limit(0))
    assert result.cleaned.count() == 0 and pipeline.report_of(result)["summary"]["original_row_count"] == 0


def test_accuracy(spark):
    a = spark.createDataFrame([(0, "Ab", "1"), (1, "c", "2")], "row_id long, s string, n string")
    b = spark.createDataFrame([(1, "c", "2"), (0, "ab", "1")], "row_id long, s string, n string")
    row = report.normalization_accuracy(a, b, "row_id", ["s", "n"]).first()
    assert (row["total_cells"], row["changed_cells"], row["percent_changed"], row["mean_text_similarity"]) == (4, 1, 25.0, 0.75)
