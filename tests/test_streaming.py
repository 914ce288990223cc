from pyspark.sql import functions as F

from millrace.functions import hashing
from millrace.streaming import dedupe, rates

SCHEMA = "id long, tenant string, ts timestamp, v double"


def source(spark, path):
    rows = [(1, "a", "2024-01-01 00:00:10", 1.0), (2, "a", "2024-01-01 00:00:20", None), (3, "b", "2024-01-01 00:01:10", 3.0), (1, "a", "2024-01-01 00:00:10", 1.0)]
    spark.createDataFrame(rows, "id long, tenant string, ts string, v double").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(path)
    return spark.readStream.schema(SCHEMA).parquet(path)


def run(spark, df, mode="append", name="out"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


def test_first_of_each(spark, tmp_path):
    stream = source(spark, str(tmp_path / "s"))
    got = run(spark, dedupe.first_of_each(stream, hashing.row_hash([F.col("id"), F.col("tenant")])), name="d1")
    assert sorted(r["id"] for r in got.collect()) == [1, 2, 3]
    timed = run(spark, dedupe.first_of_each(stream, hashing.row_hash([F.col("id")]), "ts"), name="d2")
    assert timed.count() == 3


def test_rates(spark, tmp_path):
    stream = source(spark, str(tmp_path / "s"))
    got = run(spark, rates.calls_per_window(stream, 2, late="1 minute"), "complete", "r1")
    assert sorted((r["tenant"], r["calls"], r["over_limit"]) for r in got.collect()) == [("a", 3, True), ("b", 1, False)]


def test_clean_with(spark, tmp_path):
    stream = source(spark, str(tmp_path / "s"))
    q = dedupe.clean_with(stream, {"v": {"median": 9.0, "mode": None}}, str(tmp_path / "out"), str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["v"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1.0, 1.0, 3.0, 9.0]


def ended(spark, out, name):
    q = out.writeStream.trigger(availableNow=True).format("memory").queryName(name).start()
    assert q.awaitTermination(60)
    return sorted(map(tuple, spark.table(name).collect()), key=str)


def test_first_in_order(spark, tmp_path):
    """Rows out of order over batches: the smallest number wins, and what it replaces is told."""
    for k, rows in enumerate([[("a", 5), ("b", 9), ("a", 7)], [("a", 6), ("b", 2), ("c", 4)], [("a", 1), ("c", 8), ("b", 2), ("d", None)]]):
        spark.createDataFrame(rows, "key string, n long").coalesce(1).write.mode("append").parquet(str(tmp_path / "s"))
    stream = spark.readStream.schema("key string, n long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "s"))
    assert ended(spark, dedupe.first_in_order(stream, F.col("key"), "n"), "o1") == sorted([("a", 5, None), ("b", 9, None), ("b", 2, 9), ("c", 4, None), ("a", 1, 5)], key=str)


def test_first_in_order_forgets_old_keys(spark, tmp_path):
    for rows in ([("a", 5, "00:00:00"), ("b", 6, "00:00:00")], [("c", 7, "10:00:00")], [("c", 8, "10:00:10")], [("a", 4, "09:59:30"), ("b", 7, "10:00:20")]):
        spark.createDataFrame(rows, "key string, n long, at string").selectExpr("key", "n", "timestamp('2024-01-01 ' || at) as ts").coalesce(1).write.mode("append").parquet(str(tmp_path / "s"))
    stream = spark.readStream.schema("key string, n long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "s"))
    got = ended(spark, dedupe.first_in_order(stream, F.col("key"), "n", "ts", "1 minute"), "o2")
    assert got == sorted([("a", 5, None), ("b", 6, None), ("c", 7, None), ("a", 4, None), ("b", 7, None)], key=str)
