"""Jobs and their metadata as append-only tables; the latest event of a job is its state."""

from __future__ import annotations

import functools
import json
import time
import uuid

from millrace.runtime import cut
from millrace.sources import files
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

STATES = ("queued", "pass1_running", "pass2_running", "success", "failed")
SCHEMAS = {
    "jobs": "id string, tenant_id string, dataset_name string, status string, updated_at double, error_message string, metadata string",
    "row_hashes": "job_id string, row_hash string, first_seen_row long",
    "imputation_stats": "job_id string, column string, median double, mode string, updated_at double",
    "cell_provenance": "job_id string, row_id long, column_name string, original_value string, cleaned_value string, transformation_id string, confidence_score double, source string",
    "audit_logs": "job_id string, user_id string, action string, details string, created_at double",
    "tenant_quotas": "tenant_id string, rows_per_month long, api_calls_per_sec int, max_concurrent_jobs int, updated_at double",
    "tenant_usage": "tenant_id string, period_month string, rows_processed long, api_calls long",
    "lsh_samples": "job_id string, bucket_key string, sampled_row_id long, snippet string",
    "job_progress": "job_id string, progress double, updated_at double",
    "cache": "key string, value string, expires_at double, updated_at double",
    "api_calls": "tenant_id string, call string, at double",
    "leases": "tenant_id string, lease string, expires_at double, updated_at double",
}
#: Tables of which the last record of a key is all that counts, by key and order; these can be compacted.
UPSERTS = {
    "jobs": (["id"], "updated_at"),
    "imputation_stats": (["job_id", "column"], "updated_at"),
    "tenant_quotas": (["tenant_id"], "updated_at"),
    "job_progress": (["job_id"], "updated_at"),
    "cache": (["key"], "updated_at"),
    "leases": (["tenant_id", "lease"], "updated_at"),
}
#: The column by whose value the records of a table lie in folders of their own, so that a job's can be deleted whole.
FOLDERS = {n: "id" if n == "jobs" else "job_id" for n in SCHEMAS if n == "jobs" or "job_id" in SCHEMAS[n]}


def latest(events: DataFrame, key: list[str], order: str) -> DataFrame:
    """The last record of each key: an upsert seen from the reading side."""
    w = Window.partitionBy(*key).orderBy(F.col(order).desc())
    return events.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def metrics(jobs: DataFrame) -> DataFrame:
    """Jobs by status."""
    return jobs.groupBy("status").agg(F.count(F.lit(1)).alias("jobs"))


class RateLimited(Exception):
    """A tenant makes more calls than its quota lets it."""


class TooManyJobs(Exception):
    """A tenant runs as many jobs as its quota lets it."""


class JobStore:
    """Metadata tables under one folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _pointer(self, name: str) -> dict:
        """The snapshot and the logs of which a table is made; the last log is the one to append to."""
        found = files.read_text(self.spark, f"{self.path}/{name}.json")
        return json.loads(found) if found else {"snapshot": None, "logs": ["log0"]}

    def read(self, name: str) -> DataFrame:
        """All records of a table: those of the snapshot and of the logs since."""
        now = self._pointer(name)
        folders = [f"{self.path}/{name}/{x}" for x in ([now["snapshot"]] if now["snapshot"] else []) + now["logs"]]
        folders = [f for f in folders if files.exists(self.spark, f)]
        if not folders:
            return self.spark.createDataFrame([], SCHEMAS[name])
        names = [f.split()[0] for f in SCHEMAS[name].split(", ")]
        parts = [self.spark.read.schema(SCHEMAS[name]).parquet(f).select(*names) for f in folders]
        return functools.reduce(DataFrame.unionByName, parts)

    def append(self, name: str, rows: DataFrame | list[tuple]) -> None:
        df = rows if isinstance(rows, DataFrame) else self.spark.createDataFrame(rows, SCHEMAS[name])
        self._write(name, df, self._pointer(name)["logs"][-1])

    def _write(self, name: str, df: DataFrame, folder: str) -> None:
        out = df.write.partitionBy(FOLDERS[name]) if name in FOLDERS else df.write
        out.parquet(f"{self.path}/{name}/{folder}/write={uuid.uuid4().hex}")  # a folder of its own, as writers at one folder clear each other's files

    def compact(self, name: str) -> None:
        """Puts the last record of each key into a new snapshot, so that a table has no more files than a snapshot and two logs.

        Writers are sent to a new log first; the log before is read into the
        snapshot and stays until the next time, for writers that were still at
        it: to read a record twice changes nothing. Each step is one replacement
        of the pointer, so readers see the old state or the new one, and after
        a failure at any point the table still holds every record.
        """
        key, order = UPSERTS[name]
        now = self._pointer(name)
        number = int(now["logs"][-1].removeprefix("log")) + 1
        self._point(name, {"snapshot": now["snapshot"], "logs": [*now["logs"], f"log{number}"]})
        snapshot = f"snapshot{number}-{uuid.uuid4().hex[:8]}"
        rows = latest(self.read(name), key, order)
        self._write(name, rows.repartition(FOLDERS[name]) if name in FOLDERS else rows.hint("rebalance"), snapshot)
        self._point(name, {"snapshot": snapshot, "logs": [now["logs"][-1], f"log{number}"]})
        for old in [now["snapshot"], *now["logs"][:-1]]:
            if old:
                files.delete(self.spark, f"{self.path}/{name}/{old}")

    def _point(self, name: str, pointer: dict) -> None:
        files.replace_text(self.spark, f"{self.path}/{name}.json", json.dumps(pointer))

    def create_job(self, tenant: str, dataset: str, metadata: dict | None = None) -> str:
        job = str(uuid.uuid4())
        self.append("jobs", [(job, tenant, dataset, STATES[0], time.time(), None, json.dumps(metadata or {}))])
        return job

    def update_status(self, job: str, status: str, error_message: str | None = None) -> None:
        if status not in STATES:
            raise ValueError(f"unknown status: {status}")
        now = self.get_job(job)
        if now is None:
            raise KeyError(job)
        self.append("jobs", [(job, now["tenant_id"], now["dataset_name"], status, time.time(), error_message, now["metadata"])])

    def get_job(self, job: str) -> dict | None:
        row = latest(self.read("jobs").filter(F.col("id") == job), ["id"], "updated_at").first()
        return row.asDict() if row else None

    def add_hashes(self, job: str, hashes: DataFrame) -> DataFrame:
        """Append hashes that the job lacks; gives those appended."""
        have = self.read("row_hashes").filter(F.col("job_id") == job).select("row_hash")
        fresh = cut(hashes.join(have, "row_hash", "left_anti").select(F.lit(job).alias("job_id"), "row_hash", "first_seen_row"))
        self.append("row_hashes", fresh)
        return fresh

    def save_stats(self, job: str, stats: DataFrame) -> None:
        self.append("imputation_stats", stats.select(F.lit(job).alias("job_id"), "column", F.col("median").cast("double").alias("median"), "mode", F.lit(time.time()).alias("updated_at")))

    def stats(self, job: str) -> dict[str, dict]:
        rows = latest(self.read("imputation_stats").filter(F.col("job_id") == job), ["job_id", "column"], "updated_at").collect()
        return {r["column"]: {"median": r["median"], "mode": r["mode"]} for r in rows}

    def audit(self, job: str, user: str, action: str, details: dict | None = None) -> None:
        self.append("audit_logs", [(job, user, action, json.dumps(details or {}), time.time())])

    def set_quota(self, tenant: str, rows_per_month: int = 1_000_000_000, api_calls_per_sec: int = 100, max_concurrent_jobs: int = 10) -> None:
        self.append("tenant_quotas", [(tenant, rows_per_month, api_calls_per_sec, max_concurrent_jobs, time.time())])

    def quota(self, tenant: str) -> dict | None:
        row = latest(self.read("tenant_quotas").filter(F.col("tenant_id") == tenant), ["tenant_id"], "updated_at").first()
        return row.asDict() if row else None

    def add_usage(self, tenant: str, month: str, rows: int, calls: int = 1) -> None:
        self.append("tenant_usage", [(tenant, month, rows, calls)])

    def usage(self) -> DataFrame:
        return self.read("tenant_usage").groupBy("tenant_id", "period_month").agg(F.sum("rows_processed").alias("rows_processed"), F.sum("api_calls").alias("api_calls"))

    def add_samples(self, job: str, samples: DataFrame) -> DataFrame:
        """Append LSH samples (bucket_key, sampled_row_id, snippet) that the job lacks; gives those appended."""
        have = self.read("lsh_samples").filter(F.col("job_id") == job).select("bucket_key", "sampled_row_id")
        fresh = samples.dropDuplicates(["bucket_key", "sampled_row_id"]).join(have, ["bucket_key", "sampled_row_id"], "left_anti").select(F.lit(job).alias("job_id"), "bucket_key", "sampled_row_id", "snippet")
        fresh = cut(fresh)
        self.append("lsh_samples", fresh)
        return fresh

    def set_progress(self, job: str, progress: float) -> None:
        self.append("job_progress", [(job, float(progress), time.time())])

    def progress(self, job: str) -> float | None:
        row = latest(self.read("job_progress").filter(F.col("job_id") == job), ["job_id"], "updated_at").first()
        return row and row["progress"]

    def remember(self, key: str, value: str, seconds: float = 86_400) -> None:
        """Cache a value under a key for so long."""
        self.append("cache", [(key, value, time.time() + seconds, time.time())])

    def recall(self, key: str) -> str | None:
        """The last value of a key, unless its time is over."""
        row = self.cached().filter(F.col("key") == key).first()
        return row["value"] if row else None

    def cached(self, at: float | None = None) -> DataFrame:
        """(key, value) of all that is remembered at a time, now by default."""
        return latest(self.read("cache"), ["key"], "updated_at").filter(F.col("expires_at") > (time.time() if at is None else at)).select("key", "value")

    def forget(self, job: str) -> list[str]:
        """Delete all records of a job, a folder a table; gives the tables that had some."""
        out = []
        for name, column in FOLDERS.items():
            writes = [w for part in files.children(self.spark, f"{self.path}/{name}") for w in files.children(self.spark, part)]
            if any([files.delete(self.spark, f"{w}/{column}={job}") for w in writes]):
                out.append(name)
        return out

    # ------------------------------------------------------------- admission

    def call(self, tenant: str, seconds: float = 1.0) -> None:
        """Notes a call of a tenant; an error if it makes more than its quota lets it within so many seconds.

        A call is noted before it is counted, so of calls at one time the latest
        are refused, and none is let in unseen.
        """
        limit = (self.quota(tenant) or {}).get("api_calls_per_sec")
        now, mark = time.time(), uuid.uuid4().hex
        self.append("api_calls", [(tenant, mark, now)])
        if limit is not None:
            recent = self.read("api_calls").filter((F.col("tenant_id") == tenant) & (F.col("at") > now - seconds) & (F.struct("at", "call") <= F.struct(F.lit(now), F.lit(mark))))
            made = recent.count()
            if made > limit * seconds:
                raise RateLimited(f"{tenant} made {made} calls in {seconds:g} s, {limit} a second are allowed")

    def take_lease(self, tenant: str, lease: str, seconds: float = 86_400) -> None:
        """A place among the tenant's running jobs for so long, unless given back before; an error if all are taken.

        The lease is noted before leases are counted: of those that run, the
        first by time are within the quota, and one that is not is given back.
        """
        now = time.time()
        self.append("leases", [(tenant, lease, now + seconds, now)])
        limit = (self.quota(tenant) or {}).get("max_concurrent_jobs")
        if limit is None:
            return
        own = self.read("leases").filter(F.col("tenant_id") == tenant)
        begun = own.groupBy("lease").agg(F.min("updated_at").alias("begun"), F.max_by("expires_at", "updated_at").alias("until")).filter(F.col("until") > now)
        before = begun.filter(F.struct("begun", "lease") < F.struct(F.lit(now), F.lit(lease))).count()
        if before >= limit:
            self.end_lease(tenant, lease)
            raise TooManyJobs(f"{tenant} runs {before} jobs, {limit} are allowed")

    def end_lease(self, tenant: str, lease: str) -> None:
        self.append("leases", [(tenant, lease, 0.0, time.time())])
