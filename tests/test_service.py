import pytest

from millrace.plans import service
from millrace.plans.jobs import JobStore

CSV = "id,name,email,score\n1,John Doe,j@x.org,1.5\n2,Ann Lee,a@x.org,\n3,John Doe,j@x.org,1.5\n4,Bob,,4\n"


def test_submit(spark, tmp_path):
    (tmp_path / "a.csv").write_text(CSV)
    store, out = JobStore(spark, str(tmp_path / "meta")), str(tmp_path / "out")
    job = service.submit_job(store, str(tmp_path / "a.csv"), "t", "people", out, pii={"email": "hash"}, salt="s")
    assert store.get_job(job)["status"] == "success"
    rows = service.result(store, job, out).collect()
    assert len(rows) == 3 and all(r["email"] is None or len(r["email"]) == 64 for r in rows)
    assert service.review(store, job).count() > 0 and store.stats(job)["score"]["median"] == 1.5
    assert store.read("audit_logs").count() == 2 and store.usage().first()["rows_processed"] == 4


def test_a_second_job_sees_the_first(spark, tmp_path):
    (tmp_path / "a.csv").write_text(CSV)
    (tmp_path / "b.csv").write_text(CSV + "9,New Person,n@x.org,7\n")
    store, out = JobStore(spark, str(tmp_path / "meta")), str(tmp_path / "out")
    first = service.submit_job(store, str(tmp_path / "a.csv"), "t", "people", out, near_threshold=0.85)
    assert store.read("row_hashes").count() == 3 and store.progress(first) == 1.0 and store.read("lsh_samples").count() > 0
    second = service.submit_job(store, str(tmp_path / "b.csv"), "t", "people", out, after=first)
    assert [r["name"] for r in service.result(store, second, out).collect()] == ["new person"]
    gone = store.read("cell_provenance").filter(f"job_id = '{second}' and transformation_id = 'exact_duplicate'")
    assert gone.count() == 4
    assert "cell_provenance" in store.forget(second) and store.read("row_hashes").count() == 3


def test_quota_and_failure(spark, tmp_path):
    (tmp_path / "a.csv").write_text(CSV)
    store = JobStore(spark, str(tmp_path / "meta"))
    store.set_quota("t", 3)
    with pytest.raises(service.QuotaExceeded):
        service.submit_job(store, str(tmp_path / "a.csv"), "t", "people", str(tmp_path / "out"))
    job = store.read("jobs").first()["id"]
    assert store.get_job(job)["status"] == "failed" and "rows left" in store.get_job(job)["error_message"]
    with pytest.raises(LookupError):
        service.result(store, job, str(tmp_path / "out"))
