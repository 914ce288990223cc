"""Job records: compaction that loses nothing, admission that refuses what is beyond the quota."""

import threading

import pytest
from helpers import as_rows

from millrace.plans import jobs, service
from millrace.plans.jobs import JobStore, latest
from millrace.sources import files
from millrace.streaming import rates


def quotas(spark, rows):
    return spark.createDataFrame([(t, n, 1, 1, float(at)) for t, n, at in rows], jobs.SCHEMAS["tenant_quotas"])


def state(store, name="tenant_quotas"):
    return as_rows(latest(store.read(name), *jobs.UPSERTS[name]).toPandas())


def parts(path):
    return sorted(p.name for p in path.iterdir() if p.is_dir()), len(list(path.rglob("*.parquet")))


def test_compaction_changes_no_state_and_bounds_files(spark, tmp_path):
    store, plain = JobStore(spark, str(tmp_path / "a")), JobStore(spark, str(tmp_path / "b"))
    for k in range(5):
        for s in (store, plain):
            s.append("tenant_quotas", quotas(spark, [(f"t{i % 4}", 100 * k + i, 10 * k + i) for i in range(7)]))
        store.compact("tenant_quotas")
        assert state(store) == state(plain)
        folders, _ = parts(tmp_path / "a" / "tenant_quotas")
        assert len(folders) <= 3 and sum(f.startswith("snapshot") for f in folders) == 1
    assert store.quota("t2") == plain.quota("t2")
    assert store.read("tenant_quotas").count() < plain.read("tenant_quotas").count()


def test_late_writer_is_not_lost(spark, tmp_path):
    """A record that a writer puts into the log from before a compaction is read still."""
    store = JobStore(spark, str(tmp_path))
    store.set_quota("t", 1)
    log = store._pointer("tenant_quotas")["logs"][-1]
    store.compact("tenant_quotas")
    store._write("tenant_quotas", quotas(spark, [("late", 7, 1)]), log)
    assert store.quota("late")["rows_per_month"] == 7
    store.compact("tenant_quotas")
    assert store.quota("late")["rows_per_month"] == 7 and store.quota("t")["rows_per_month"] == 1


@pytest.mark.parametrize("step", ["_write", "_point", "delete"])
def test_compaction_that_breaks_off_loses_nothing(spark, tmp_path, monkeypatch, step):
    store = JobStore(spark, str(tmp_path))
    for k in range(3):
        store.append("tenant_quotas", quotas(spark, [(f"t{i}", k, k) for i in range(5)]))
        if k < 2:
            store.compact("tenant_quotas")
    before, calls = state(store), []

    def broken(*args):
        calls.append(args)
        raise OSError("lost")

    with monkeypatch.context() as m:
        if step == "delete":
            m.setattr(files, "delete", broken)
        elif step == "_point":  # the second replacement, that of the snapshot
            real = store._point
            m.setattr(store, "_point", lambda name, p: broken() if len(p["logs"]) == 2 and p["snapshot"] != before_snapshot else real(name, p))
            before_snapshot = store._pointer("tenant_quotas")["snapshot"]
        else:
            m.setattr(store, step, broken)
        with pytest.raises(OSError):
            store.compact("tenant_quotas")
    assert calls and state(store) == before
    store.set_quota("t1", 99)
    assert store.quota("t1")["rows_per_month"] == 99
    store.compact("tenant_quotas")
    assert store.quota("t1")["rows_per_month"] == 99 and store.quota("t4")["rows_per_month"] == 2


def test_forgotten_jobs_stay_forgotten(spark, tmp_path):
    store = JobStore(spark, str(tmp_path))
    a, b = store.create_job("t", "a"), store.create_job("t", "b")
    store.compact("jobs")
    store.update_status(a, "success")
    assert store.get_job(a)["status"] == "success"
    assert store.forget(a) == ["jobs"] and store.get_job(a) is None and store.get_job(b)["status"] == "queued"
    store.compact("jobs")
    assert store.get_job(a) is None and store.get_job(b)["dataset_name"] == "b"


def test_calls_beyond_the_quota_are_refused(spark, tmp_path):
    store = JobStore(spark, str(tmp_path))
    store.call("free")
    store.set_quota("t", api_calls_per_sec=1)
    for _ in range(2):
        store.call("t", 600 / 300)
    with pytest.raises(jobs.RateLimited):
        for _ in range(700):
            store.call("t", 600)
            store.append("api_calls", spark.range(600).selectExpr("'t' as tenant_id", "string(id) as call", "unix_micros(current_timestamp()) / 1e6 as at"))


def test_leases(spark, tmp_path):
    store = JobStore(spark, str(tmp_path))
    store.set_quota("t", max_concurrent_jobs=2)
    store.take_lease("t", "a")
    store.take_lease("t", "gone", -1)  # its time is over
    store.take_lease("t", "b")
    store.take_lease("other", "x")
    with pytest.raises(jobs.TooManyJobs):
        store.take_lease("t", "c")
    store.end_lease("t", "a")
    store.compact("leases")
    store.take_lease("t", "d")
    with pytest.raises(jobs.TooManyJobs):
        store.take_lease("t", "e")


def test_leases_taken_at_once(spark, tmp_path):
    """Of many that ask at one time no more than the quota run."""
    store, got, refused = JobStore(spark, str(tmp_path)), [], []
    store.set_quota("t", max_concurrent_jobs=2)

    def take(name):
        try:
            store.take_lease("t", name)
            got.append(name)
        except jobs.TooManyJobs:
            refused.append(name)

    threads = [threading.Thread(target=take, args=(f"j{k}",)) for k in range(5)]
    for x in threads:
        x.start()
    for x in threads:
        x.join()
    assert len(got) <= 2 and len(got) + len(refused) == 5


def test_submitting_asks_first_and_failures_cost_nothing(spark, tmp_path):
    (tmp_path / "in.csv").write_text("id,name\n1,a\n2,b\n")
    store = JobStore(spark, str(tmp_path / "meta"))
    store.set_quota("t", max_concurrent_jobs=1)
    store.take_lease("t", "running")
    with pytest.raises(jobs.TooManyJobs):
        service.submit_job(store, str(tmp_path / "in.csv"), "t", "d", str(tmp_path / "out"))
    store.end_lease("t", "running")
    job = service.submit_job(store, str(tmp_path / "in.csv"), "t", "d", str(tmp_path / "out"))
    assert service.result(store, job, str(tmp_path / "out")).count() == 2
    used = lambda: {r["tenant_id"]: r["rows_processed"] for r in store.usage().collect()}["t"]
    assert used() == 2
    (tmp_path / "out2").write_text("in the way")
    with pytest.raises(Exception):  # noqa: B017
        service.submit_job(store, str(tmp_path / "in.csv"), "t", "d", str(tmp_path / "out2"))
    assert used() == 2
    service.submit_job(store, str(tmp_path / "in.csv"), "t", "d", str(tmp_path / "out"))  # the lease of the failed one is free again


def test_sliding_window_is_the_plain_count(spark):
    import random

    r = random.Random(4)
    rows = [(k, "hot" if r.random() < 0.5 else f"t{r.randrange(3)}", r.randrange(0, 4000) / 10) for k in range(600)]
    calls = spark.createDataFrame(rows, "id long, tenant string, at double").selectExpr("id", "tenant", "timestamp_micros(cast(at * 1e6 as long)) as ts", "at")
    got = {x["id"]: x["within"] for x in rates.calls_within(calls, 7).collect()}
    assert got == {k: sum(u == t and a - 7 + 1e-9 < b <= a for _, u, b in rows) for k, t, a in rows}
    limits = spark.createDataFrame([("hot", 3), ("t1", 0)], "tenant string, limit int")
    assert {x["id"] for x in rates.refused(calls, limits, 7).collect()} == {k for k, t, _ in rows if t == "hot" and got[k] > 3 or t == "t1"}
