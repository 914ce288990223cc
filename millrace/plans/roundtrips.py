"""Queries over sources, sinks, job records, the command line and streams: a table goes out to the shared folder and comes back."""

from __future__ import annotations

import functools
from contextlib import contextmanager

from millrace.functions import hashing, text
from millrace.operators import clean, dedupe, enrich, report, shape
from millrace.plans.jobs import JobStore, latest
from millrace.plans.registry import Tables, query
from millrace.runtime import cut, scratch
from millrace.sources import files, readers, sinks, synthetic
from millrace.streaming.dedupe import clean_with, first_in_order, first_of_each
from millrace.streaming.rates import calls_per_window, refused
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _back(t: Tables, df: DataFrame, name: str) -> DataFrame:
    """The table written under a name and read by its suffix."""
    path = f"{scratch(t.spark)}/{name}"
    sinks.write(df, path)
    return readers.read_any(t.spark, path)


# ------------------------------------------------------------ files out and in


@query("SELECT c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey, c_acctbal, c_mktsegment FROM customer")
def csv_round_trip(t):
    return _back(t, t("customer"), "customer.csv")


@query("""SELECT doc_id, 'a "' || source || '",' || chr(10) || ' ' || text AS note, lang FROM documents""")
def csv_quoted_lines(t):
    """Quotes, commas, outer spaces and line ends within values, read in as many tasks as the files have splits."""
    note = F.concat(F.lit('a "'), F.col("source"), F.lit('",\n '), F.col("text"))
    return _back(t, t("documents").select("doc_id", note.alias("note"), "lang"), "documents.csv")


@query("SELECT event_id, CASE WHEN event_id % 8 >= 6 THEN event_type END AS event_type FROM events")
def csv_missing_values(t):
    """The spellings of a missing value are null."""
    gone = F.array(*[F.lit(x) for x in ("NA", "null", "N/A", "nan", "#N/A", "None")])
    spelt = F.when(F.col("event_id") % 8 >= 6, F.col("event_type")).otherwise(F.get(gone, (F.col("event_id") % 8).cast("int")))
    return _back(t, t("events").select("event_id", spelt.alias("event_type")), "events.csv")


@query("""SELECT event_id, 'x' || event_id AS "who.name", '["' || event_type || '"]' AS tags, (event_id % 5)::BIGINT AS "who.at.level" FROM events""")
def jsonl_flattened(t):
    """Nested JSON lines: structs as dotted columns, arrays as JSON text."""
    who = F.struct(F.concat(F.lit("x"), F.col("event_id")).alias("name"), F.struct((F.col("event_id") % 5).alias("level")).alias("at"))
    return _back(t, t("events").select("event_id", who.alias("who"), F.array("event_type").alias("tags")), "events.jsonl")


@query("SELECT event_id, event_type FROM events WHERE event_id % 10 <> 0")
def jsonl_lenient(t):
    """Broken lines are skipped."""
    line = F.when(F.col("event_id") % 10 == 0, F.lit('{"event_id": oops')).otherwise(F.to_json(F.struct("event_id", "event_type")))
    path = f"{scratch(t.spark)}/events.jsonl"
    t("events").select(line.alias("value")).write.text(path)
    return readers.read_any(t.spark, path, strict=False).select("event_id", "event_type")


@query("""SELECT event_id AS key, 'a "{[\\' || event_type AS "place.name", user_id AS "place.at.user", '["}",' || event_id || ']' AS tags FROM events""")
def json_array(t):
    """JSON documents, each an array of nested objects with brackets and quotes in their texts, read in as many tasks as they have splits."""
    at = F.struct(F.col("user_id").alias("user"))
    place = F.struct(F.concat(F.lit('a "{[\\'), F.col("event_type")).alias("name"), at.alias("at"))
    tags = F.array(F.lit("}"), F.col("event_id").cast("string"))
    out = _back(t, t("events").select(F.col("event_id").alias("key"), place.alias("place"), tags.alias("tags")), "events.json")
    return out.withColumn("tags", F.regexp_replace("tags", r'"(\d+)"', "$1"))


@query("SELECT s_suppkey, s_name, s_nationkey::BIGINT AS s_nationkey, s_acctbal FROM supplier")
def xlsx_round_trip(t):
    return _back(t, t("supplier"), "supplier.xlsx")


@query("SELECT s_suppkey, s_name FROM supplier")
def xls_as_csv(t):
    """CSV under the suffix .xls."""
    path = f"{scratch(t.spark)}/supplier.xls"
    t("supplier").select("s_suppkey", "s_name").write.option("header", True).csv(path)
    return readers.read_any(t.spark, path)


@query("SELECT * FROM orders")
def parquet_round_trip(t):
    return _back(t, t("orders"), "orders.parquet")


@query("SELECT * FROM part")
def reader_by_uri(t):
    """A path with a scheme."""
    path = f"{scratch(t.spark)}/part.parquet"
    sinks.write(t("part"), path)
    return readers.read_any(t.spark, path if "://" in path or path.startswith("file:") else f"file://{path}")


@contextmanager
def _mounted(t: Tables, folder: str):
    """The schemes of object stores over a local folder, as a test file system of Hadoop's; without it they lead where they always do."""
    conf, settings = t.spark.sparkContext._jsc.hadoopConfiguration(), {}
    local = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    for scheme in ("s3a", "gs", "abfss"):
        settings[f"fs.{scheme}.impl"] = "org.apache.hadoop.fs.viewfs.ViewFileSystemOverloadScheme"
        settings[f"fs.viewfs.overload.scheme.target.{scheme}.impl"] = "org.apache.hadoop.fs.LocalFileSystem"
        settings[f"fs.{scheme}.impl.disable.cache"] = "true"
        settings[f"mapreduce.outputcommitter.factory.scheme.{scheme}"] = "org.apache.hadoop.mapreduce.lib.output.FileOutputCommitterFactory"
    settings["fs.viewfs.mounttable.millrace-test.link./in"] = local
    before = {k: conf.get(k) for k in settings}
    for k, v in settings.items():
        conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)


@query("SELECT p_partkey, p_name, p_brand, scheme FROM part, (VALUES ('s3'), ('s3a'), ('gs'), ('abfss')) AS v(scheme)")
def uri_schemes(t):
    """A table written and read under the scheme of each object store, CSV, JSON lines, JSON documents and Parquet."""
    folder, parts = scratch(t.spark), []
    part = t("part").select("p_partkey", "p_name", "p_brand")
    files.make(t.spark, folder)
    with _mounted(t, folder):
        for scheme, kind in (("s3", "csv"), ("s3a", "jsonl"), ("gs", "json"), ("abfss", "parquet")):
            path = f"{scheme}://millrace-test/in/part.{kind}"
            sinks.write(part, path)
            parts.append(cut(readers.read_any(t.spark, path).select("p_partkey", "p_name", "p_brand", F.lit(scheme).alias("scheme"))))
    return functools.reduce(DataFrame.union, parts)


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 100")
def head_scan(t):
    path = f"{scratch(t.spark)}/customer.csv"
    sinks.write(t("customer").select("c_custkey", "c_name").orderBy("c_custkey"), path, one_file=True)
    return readers.head(t.spark, path, 100)


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 100")
def head_scan_of_json(t):
    """JSON lines under a name that tells nothing."""
    path = f"{scratch(t.spark)}/customer.txt"
    t("customer").orderBy("c_custkey").select(F.to_json(F.struct("c_custkey", "c_name")).alias("value")).coalesce(1).write.text(path)
    return readers.head(t.spark, path, 100)


def _synthetic_sql(seed: int) -> str:
    """The generator's records in SQL, for the ids of customers."""
    d = lambda name: f"(('0x' || md5('{name}|{seed}|' || id)[1:8])::UBIGINT / 4294967296.0::DOUBLE)"
    pick = lambda name, values: "[" + ", ".join(f"'{v}'" for v in values) + f"][floor({d(name)} * {len(values)})::INT + 1]"
    number = lambda name, low, high: f"({low} + floor({d(name)} * {high - low + 1})::BIGINT)::VARCHAR"
    hole = lambda k, c: f"CASE WHEN NOT (noise >= 0.05 AND noise < 0.15 AND floor({d('hole')} * 4) = {k}) THEN {c} END"
    pad = lambda c: f"CASE WHEN noise >= 0.30 AND noise < 0.35 THEN '  ' || {c} || '  ' ELSE {c} END"
    typo = lambda c, k: f"CASE WHEN noise >= 0.15 AND noise < 0.25 AND floor({d('field')} * 2) = {k} THEN {c}[1] || {c} ELSE {c} END"
    return f"""WITH c AS (SELECT c_custkey AS id FROM customer), n AS (SELECT id, CASE WHEN {d("dirty")} < 0.2 THEN {d("noise")} ELSE 1.0 END AS noise, {pick("first", synthetic.FIRST)} AS f, {pick("last", synthetic.LAST)} AS l FROM c)
SELECT 'CUST-' || lpad(CASE WHEN {d("repeat")} < 0.05 AND id > 0 THEN floor({d("which")} * id)::BIGINT ELSE id END::VARCHAR, 9, '0') AS customer_id, {pad("(" + typo("f", 0) + ")")} AS first_name, {pad("(" + typo("l", 1) + ")")} AS last_name,
 {hole(0, "lower(f) || '.' || lower(l) || '@example.com'")} AS email, {hole(1, "'+1-' || " + " || '-' || ".join(number(*x) for x in (("p1", 200, 999), ("p2", 2000, 9999), ("p3", 1000, 9999))))} AS phone,
 {hole(2, pick("city", synthetic.CITIES))} AS city, {pick("state", synthetic.STATES)} AS state, {number("zip", 10_000, 99_999)} AS zip_code, {hole(3, pick("industry", synthetic.INDUSTRIES))} AS industry,
 strftime(DATE '2022-01-01' + floor({d("date")} * 1000)::INT, '%Y-%m-%d') AS signup_date, round(CASE WHEN noise >= 0.25 AND noise < 0.30 THEN 50000 + {d("spend")} * 950000 ELSE 100 + {d("spend")} * 49900 END, 2) AS total_spend, {pick("status", synthetic.STATUSES)} AS account_status FROM n"""


@query(_synthetic_sql(7))
def synthetic_records(t):
    """Dirty records for the ids of customers."""
    return synthetic.records(t("customer").select(F.col("c_custkey").alias("id")), 7)


@query("""SELECT count(*) AS original_row_count, count(*) FILTER (event_id % 4 <> 0) AS cleaned_row_count, count(*) FILTER (event_id % 4 = 0) AS rows_dropped_total FROM events""")
def report_written(t):
    """A report as a JSON document, read back."""
    rows = t("events").select("event_id", "event_type")
    row = report.summary(rows, rows.filter("event_id % 4 <> 0")).first().asDict()
    path = f"{scratch(t.spark)}/report.json"
    sinks.write_report(t.spark, {"summary": row}, path)
    return t.spark.read.option("multiLine", True).json(path).select("summary.original_row_count", "summary.cleaned_row_count", "summary.rows_dropped_total")


@query(r"""SELECT p_partkey, p_type, len(regexp_extract_all(p_type, '\S+')) AS p_type__token_count, (SELECT p_type FROM part GROUP BY 1 ORDER BY count(*) DESC, p_type LIMIT 1) AS p_type__suggested_canonical FROM part""")
def enriched_csv(t):
    return _back(t, enrich.enrich(t("part").select("p_partkey", "p_type"), ["p_type"]), "enriched.csv")


# ------------------------------------------------------------------ job records


@query("SELECT o_custkey, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1")
def upsert_last_wins(t):
    return latest(t("orders"), ["o_custkey"], "o_orderkey").select("o_custkey", "o_orderkey", "o_orderstatus")


@query("""WITH h AS (SELECT md5(lower(p_brand) || '|' || p_type) AS row_hash, p_partkey FROM part), a AS (SELECT row_hash, min(p_partkey) AS first_seen_row FROM h WHERE p_partkey % 2 = 0 GROUP BY 1)
SELECT * FROM a UNION ALL SELECT row_hash, min(p_partkey) FROM h WHERE p_partkey % 2 = 1 AND row_hash NOT IN (SELECT row_hash FROM a) GROUP BY 1""")
def state_store(t):
    """Hashes appended by two runs lie in the store once, with the row that brought them."""
    store = JobStore(t.spark, scratch(t.spark))
    rows = t("part").select("p_partkey", hashing.joined_hash([F.lower("p_brand"), F.col("p_type")]).alias("h"))
    for half in (0, 1):
        first = dedupe.keep_first(rows.filter(F.col("p_partkey") % 2 == half), F.col("h"), "p_partkey")
        store.add_hashes("j", first.select(F.col("h").alias("row_hash"), F.col("p_partkey").alias("first_seen_row")))
    return store.read("row_hashes").select("row_hash", "first_seen_row")


@query("""SELECT c_nationkey::VARCHAR AS id, c_mktsegment AS dataset_name, CASE WHEN c_custkey % 3 = 0 THEN 'failed' ELSE 'success' END AS status, CASE WHEN c_custkey % 3 = 0 THEN c_name END AS error_message, c_acctbal AS progress
FROM customer WHERE c_nationkey % 5 <> 1 QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey DESC) = 1""")
def job_lifecycle(t):
    """Jobs after their last event and with their last progress, of which the store holds a snapshot and what came later; a fifth of them is forgotten."""
    store = JobStore(t.spark, scratch(t.spark))
    failed = F.col("c_custkey") % 3 == 0
    at, job = F.col("c_custkey").cast("double"), F.col("c_nationkey").cast("string")
    events = t("customer").select(job.alias("id"), F.lit("t").alias("tenant_id"), F.col("c_mktsegment").alias("dataset_name"), F.when(failed, "failed").otherwise("success").alias("status"), at.alias("updated_at"), F.when(failed, F.col("c_name")).alias("error_message"), F.lit("{}").alias("metadata"))
    shares = t("customer").select(job.alias("job_id"), F.col("c_acctbal").alias("progress"), at.alias("updated_at"))
    for half in (1, 0):
        for name, rows in (("jobs", events), ("job_progress", shares)):
            store.append(name, rows.filter(F.col("updated_at") % 2 == half).repartition(1))
            if half:
                store.compact(name)
    for gone in range(1, 25, 5):
        store.forget(str(gone))
    progress = latest(store.read("job_progress"), ["job_id"], "updated_at").select(F.col("job_id").alias("id"), "progress")
    return latest(store.read("jobs"), ["id"], "updated_at").join(progress, "id").select("id", "dataset_name", "status", "error_message", "progress")


@query("""SELECT c_nationkey::VARCHAR AS tenant_id, max(c_custkey)::BIGINT AS rows_per_month FROM customer GROUP BY 1""")
def compacted_quotas(t):
    """Each tenant's last quota, over three logs of which two are compacted."""
    store = JobStore(t.spark, scratch(t.spark))
    rows = t("customer").select(F.col("c_nationkey").cast("string").alias("tenant_id"), F.col("c_custkey").alias("rows_per_month"), F.lit(1).alias("api_calls_per_sec"), F.lit(1).alias("max_concurrent_jobs"), F.col("c_custkey").cast("double").alias("updated_at"))
    for part in range(3):
        store.append("tenant_quotas", rows.filter(F.col("rows_per_month") % 3 == part))
        if part < 2:
            store.compact("tenant_quotas")
    return latest(store.read("tenant_quotas"), ["tenant_id"], "updated_at").select("tenant_id", "rows_per_month")


@query("""SELECT event_id, event_type AS tenant, count(*) OVER w AS within FROM events WINDOW w AS (PARTITION BY event_type ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) QUALIFY within > 5""")
def refused_calls(t):
    """Events as calls of five tenants: those beyond five within an hour, wherever the hour begins."""
    calls = t("events").select("event_id", F.col("event_type").alias("tenant"), "ts")
    limits = t("events").select(F.col("event_type").alias("tenant"), F.lit(5).alias("limit")).distinct()
    return refused(calls, limits, 3600).select("event_id", "tenant", "within")


@query("""SELECT event_type AS job_id, count(*) AS records FROM events WHERE event_type <> 'click' GROUP BY 1""")
def job_cascade_delete(t):
    """All records of a job go with it, and no others."""
    store = JobStore(t.spark, scratch(t.spark))
    none = F.lit(None).cast("string")
    store.append("cell_provenance", t("events").select(F.col("event_type").alias("job_id"), F.col("event_id").alias("row_id"), F.lit("value").alias("column_name"), none.alias("original_value"), none.alias("cleaned_value"), F.lit("cleaned").alias("transformation_id"), F.lit(1.0).alias("confidence_score"), F.lit("clean").alias("source")))
    store.forget("click")
    return store.read("cell_provenance").groupBy("job_id").agg(F.count(F.lit(1)).alias("records"))


@query("""SELECT user_id::VARCHAR AS tenant_id, strftime(ts, '%Y-%m') AS period_month, sum(1)::BIGINT AS rows_processed, count(*) AS api_calls, count(*) > 3 AS over_quota FROM events GROUP BY 1, 2""")
def quota_usage(t):
    """Usage by tenant and month against the quota set last."""
    store = JobStore(t.spark, scratch(t.spark))
    store.append("tenant_usage", t("events").select(F.col("user_id").cast("string").alias("tenant_id"), F.date_format("ts", "yyyy-MM").alias("period_month"), F.lit(1).cast("long").alias("rows_processed"), F.lit(1).cast("long").alias("api_calls")))
    for rows in (1_000_000, 3):
        store.set_quota("all", rows)
    return store.usage().withColumn("over_quota", F.col("rows_processed") > store.quota("all")["rows_per_month"])


@query("""SELECT c_mktsegment || c_nationkey AS key, c_name AS value FROM customer QUALIFY row_number() OVER (PARTITION BY c_mktsegment, c_nationkey ORDER BY c_custkey DESC) = 1 AND c_custkey % 4 > 0""")
def cached_values(t):
    """What is remembered under each key, the last value, unless its time is over."""
    store = JobStore(t.spark, scratch(t.spark))
    over = F.when(F.col("c_custkey") % 4 > 0, 2e9).otherwise(1e9)
    store.append("cache", t("customer").select(F.concat("c_mktsegment", "c_nationkey").alias("key"), F.col("c_name").alias("value"), over.alias("expires_at"), F.col("c_custkey").cast("double").alias("updated_at")))
    return store.cached(1.5e9)


_CLEAN = r"regexp_replace(trim(lower({c})), '^[^\w]+|[^\w]+$', '', 'g')"


@query(f"""WITH d AS (SELECT c_custkey, {_CLEAN.format(c="c_mktsegment")} AS c_mktsegment, c_nationkey::BIGINT AS c_nationkey FROM customer) SELECT min(c_custkey) AS c_custkey, c_mktsegment, c_nationkey FROM d GROUP BY 2, 3""")
def submitted_job(t):
    """A file cleaned as a job, and its result: rows that repeat all but the column id go."""
    from millrace.plans import service

    base = scratch(t.spark)
    rows = t("customer").select(F.col("c_custkey").alias("id"), "c_mktsegment", "c_nationkey").orderBy("id")
    sinks.write(rows, f"{base}/in.csv", one_file=True)
    store = JobStore(t.spark, f"{base}/meta")
    job = service.submit_job(store, f"{base}/in.csv", "tenant", "customers", f"{base}/out")
    return service.result(store, job, f"{base}/out").select(F.col("id").alias("c_custkey"), "c_mktsegment", "c_nationkey")


@query("""WITH d AS (SELECT DISTINCT n_regionkey FROM nation) SELECT (SELECT count(*) FROM nation) AS row_count, count(*) AS rows_kept, (SELECT count(*) FROM nation) - count(*) AS rows_dropped FROM d""")
def command_line_run(t):
    """The run command: both passes over a file, figures as JSON."""
    from millrace.plans import cli

    base = scratch(t.spark)
    sinks.write(t("nation").select(F.col("n_nationkey").alias("id"), "n_regionkey"), f"{base}/nation.csv", one_file=True)
    cli.main(["run", "-i", f"{base}/nation.csv", "-o", f"{base}/out"], t.spark)
    return t.spark.read.option("multiLine", True).json(f"{base}/out/stats_nation.json").select("pass1.row_count", "pass2.rows_kept", "pass2.rows_dropped")


@query("""SELECT count(*) AS total_cells, count(*) FILTER (p_type <> lower(p_type)) AS changed_cells FROM part""")
def command_line_benchmark(t):
    """The clean command with its benchmark, from the report that it writes."""
    from millrace.plans import cli

    base = scratch(t.spark)
    sinks.write(t("part").select("p_type", "p_partkey"), f"{base}/part.csv", one_file=True)
    cli.main(["clean", "-i", f"{base}/part.csv", "-o", f"{base}/out", "--benchmark", "--intensity", "light"], t.spark)
    return t.spark.read.option("multiLine", True).json(f"{base}/out/clean_report.json").select("normalization.total_cells", "normalization.changed_cells")


# -------------------------------------------------------------------- streams


def _streamed(t: Tables, name: str, columns: list[str]) -> DataFrame:
    """A table as a stream of files."""
    return t.spark.readStream.schema(t(name).schema).parquet(f"{t.base.rstrip('/')}/{name}.parquet*").select(*columns)


def _ended(t: Tables, out: DataFrame, mode: str = "append") -> DataFrame:
    """What a stream has written once all files are read."""
    base = scratch(t.spark)
    if mode == "append":
        out.writeStream.option("checkpointLocation", f"{base}/log").trigger(availableNow=True).format("parquet").option("path", f"{base}/out").start().awaitTermination()
        return t.spark.read.schema(out.schema).parquet(f"{base}/out")

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out")

    out.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/log").trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    return t.spark.read.parquet(f"{base}/out")


@query("SELECT DISTINCT md5(event_type || '|' || (user_id % 10)) AS row_hash FROM events")
def stream_one_of_each(t):
    rows = _streamed(t, "events", ["event_type", "user_id"])
    return _ended(t, first_of_each(rows, hashing.joined_hash([F.col("event_type"), F.col("user_id") % 10])).select("row_hash"))


@query("""WITH k AS (SELECT md5(event_type || '|' || (user_id % 40)) AS row_hash, event_id, event_id % 3 AS batch FROM events),
b AS (SELECT row_hash, min(event_id) AS row_number, min(event_id) FILTER (batch = 2) AS x, min(event_id) FILTER (batch = 1) AS y, min(event_id) FILTER (batch = 0) AS z FROM k GROUP BY 1)
SELECT row_hash, row_number, ((x IS NOT NULL)::INT + (y < coalesce(x, y + 1))::INT + (z < least(coalesce(x, z + 1), coalesce(y, z + 1)))::INT)::BIGINT AS told
FROM (SELECT row_hash, row_number, x, coalesce(y, 1::BIGINT << 60) AS y, coalesce(z, 1::BIGINT << 60) AS z FROM b)""")
def stream_first_of_each(t):
    """The first row of each key over three micro-batches that bring rows out of order, and how often the key was told."""
    folder = f"{scratch(t.spark)}/events"
    rows = t("events").select("event_id", "event_type", "user_id")
    for batch in (2, 1, 0):
        rows.filter(F.col("event_id") % 3 == batch).coalesce(1).write.mode("append").parquet(folder)
    stream = t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    told = _ended(t, first_in_order(stream, hashing.joined_hash([F.col("event_type"), F.col("user_id") % 40]), "event_id"))
    return told.groupBy("row_hash").agg(F.min("row_number").alias("row_number"), F.count(F.lit(1)).alias("told"))


@query("""SELECT event_type AS tenant, time_bucket(INTERVAL '3600 seconds', ts) AS window_start, count(*) AS calls, count(*) > 5 AS over_limit FROM events GROUP BY 1, 2""")
def stream_rate_window(t):
    calls = _streamed(t, "events", ["event_type", "ts"]).select(F.col("event_type").alias("tenant"), "ts")
    return _ended(t, calls_per_window(calls, 5, "3600 seconds"), "complete")


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 1.5 ELSE value END AS value, event_id % 3 = 0 AS value_was_imputed FROM events")
def stream_frozen_statistics(t):
    """Batches cleaned with statistics from before."""
    base = scratch(t.spark)
    rows = _streamed(t, "events", ["event_id", "value"]).withColumn("value", F.when(F.col("event_id") % 3 != 0, F.col("value")))
    clean_with(rows, {"value": {"median": 1.5, "mode": None}}, f"{base}/out", f"{base}/log").trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.parquet(f"{base}/out").select("event_id", "value", "value_was_imputed")


# ---------------------------------------------------------- whole pipelines


@query("SELECT min(o_orderkey) AS row_id, lower(o_orderpriority) AS o_orderpriority, o_custkey FROM orders GROUP BY 2, 3")
def full_pipeline(t):
    """Exact duplicates out and texts in lower case, composed by transform as a user's own steps would be."""
    rows = t("orders").select(F.col("o_orderkey").alias("row_id"), "o_orderpriority", "o_custkey")
    return (
        rows.transform(lambda df: dedupe.keep_first(df, hashing.joined_hash([F.col("o_orderpriority"), F.col("o_custkey")]), "row_id"))
        .transform(lambda df: clean.lower_columns(clean.strip_columns(df, ["o_orderpriority"]), ["o_orderpriority"]))
        .transform(lambda df: df.withColumn("o_orderpriority", text.canonical(F.col("o_orderpriority"), {})))
    )


@query("""SELECT n_nationkey AS row_id, '{"n": {"name": "' || n_name || '", "none": null}}' AS raw, n_name AS name FROM nation""")
def drifting_json(t):
    """JSON whose fields drift, as a variant; fields are taken out by path."""
    raw = F.concat(F.lit('{"n": {"name": "'), F.col("n_name"), F.lit('", "none": null}}'))
    return t("nation").select(F.col("n_nationkey").alias("row_id"), raw.alias("raw")).withColumn("name", shape.at_path(F.col("raw"), "$.n.name"))

