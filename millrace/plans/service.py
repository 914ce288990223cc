"""Submitting files as jobs: quota, privacy, the two passes, status and results in one call."""

from __future__ import annotations

import time

from millrace.functions import privacy
from millrace.operators import lineage, shape
from millrace.plans import pipeline
from millrace.plans.jobs import JobStore
from millrace.sources import readers, sinks
from pyspark.sql import functions as F


class QuotaExceeded(Exception):
    """A tenant has no rows left this month."""


def submit_job(store: JobStore, path: str, tenant: str, dataset: str, output_dir: str, user: str = "system", pii: dict[str, str] | None = None, salt: str = "", near_threshold: float | None = None, after: str | None = None) -> str:
    """Clean a file as a tenant's job; gives the job's id.

    after: an earlier job whose rows count as seen, so that only new ones stay.

    The store is asked first whether the tenant may call and run one more job.
    Results lie under output_dir/<job>; the store has status, statistics,
    hashes, provenance, audit records and usage. A failure is recorded and raised.
    """
    store.call(tenant)
    job = store.create_job(tenant, dataset, {"path": path, "pii": pii or {}})
    store.audit(job, user, "submit", {"path": path})
    charged = 0
    try:
        store.take_lease(tenant, job)
        store.update_status(job, "pass1_running")
        store.set_progress(job, 0.0)
        rows = shape.with_row_id(privacy.protect(readers.read_any(store.spark, path), pii or {}, salt))
        month, n = time.strftime("%Y-%m"), rows.count()
        _charge(store, tenant, month, n)
        charged = n
        seen = None if after is None else store.read("row_hashes").filter(F.col("job_id") == after).select("row_hash")
        result = pipeline.clean_worker(rows, job_id=job, near_threshold=near_threshold, seen=seen)
        store.save_stats(job, store.spark.createDataFrame([(c, s["median"], s["mode"]) for c, s in result.stats.items()], "column string, median double, mode string"))
        store.update_status(job, "pass2_running")
        store.set_progress(job, 0.5)
        sinks.write(result.cleaned, f"{output_dir}/{job}/cleaned.parquet")
        store.append("cell_provenance", result.provenance)
        store.add_hashes(job, result.extra["hashes"])
        if near_threshold is not None:
            store.add_samples(job, result.extra["samples"])
        figures = lineage.worker_stats(rows, result.cleaned, result.changes, result.scores).first().asDict()
        sinks.write_report(store.spark, {"job": job, "worker": figures, "stats": result.stats}, f"{output_dir}/{job}/report.json")
        store.audit(job, user, "finish", figures)
        result.release()
        store.set_progress(job, 1.0)
        store.update_status(job, "success")
    except Exception as e:
        if charged:
            store.add_usage(tenant, month, -charged, 0)  # what failed costs no rows
        store.update_status(job, "failed", str(e)[:1000])
        raise
    finally:
        store.end_lease(tenant, job)
    return job


def _charge(store: JobStore, tenant: str, month: str, rows: int) -> None:
    quota = store.quota(tenant)
    used = store.usage().filter((F.col("tenant_id") == tenant) & (F.col("period_month") == month)).agg(F.sum("rows_processed")).first()[0] or 0
    if quota and used + rows > quota["rows_per_month"]:
        raise QuotaExceeded(f"{tenant} has {quota['rows_per_month'] - used} rows left in {month}, the file has {rows}")
    store.add_usage(tenant, month, rows)


def result(store: JobStore, job: str, output_dir: str):
    """The cleaned rows of a job that succeeded."""
    state = store.get_job(job)
    if state is None or state["status"] != "success":
        raise LookupError(f"job {job} has no result: {state and state['status']}")
    return store.spark.read.parquet(f"{output_dir}/{job}/cleaned.parquet")


def review(store: JobStore, job: str, low: float = 0.0, high: float = 0.95):
    """Cells of a job whose confidence lies in the range."""
    return lineage.needs_review(store.read("cell_provenance").filter(F.col("job_id") == job), low, high)


