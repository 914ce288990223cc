import json
import zipfile

import pytest

from millrace.plans import cli
from millrace.plans.jobs import JobStore
from millrace.sources import readers, sinks, synthetic


def put(path, content):
    path.write_text(content)
    return str(path)


def test_csv(spark, tmp_path):
    df = readers.read_any(spark, put(tmp_path / "a.csv", 'id,name,price\n1,"A ""q""\nline",9.5\n2,NaN,\n3,c,99999\n'))
    assert dict(df.dtypes) == {"id": "bigint", "name": "string", "price": "double"}
    assert [tuple(r) for r in df.orderBy("id").collect()] == [(1, 'A "q"\nline', 9.5), (2, None, None), (3, "c", 99999.0)]


def test_header_only_csv(spark, tmp_path):
    df = readers.read_any(spark, put(tmp_path / "a.csv", "id,name,email\n"))
    assert df.columns == ["id", "name", "email"] and df.count() == 0


def test_jsonl(spark, tmp_path):
    path = put(tmp_path / "a.jsonl", '{"id": 1, "u": {"n": "x"}, "t": ["a"]}\n{"id": 2, "v": null}\n')
    df = readers.read_any(spark, path)
    assert df.columns == ["id", "t", "u.n", "v"] or df.columns == ["id", "t", "u.n"]
    assert [tuple(r)[:3] for r in df.orderBy("id").collect()] == [(1, '["a"]', "x"), (2, None, None)]


def test_bad_line(spark, tmp_path):
    path = put(tmp_path / "a.jsonl", '{"id": 1, "name": "a"}\n{oops\n{"id": 2, "name": "b"}\n')
    assert len(readers.read_any(spark, path, strict=False).collect()) == 2
    with pytest.raises(Exception):
        readers.read_any(spark, path).collect()


def test_json_array_and_object(spark, tmp_path):
    assert readers.read_any(spark, put(tmp_path / "a.json", '[{"a": {"b": 1}}, {"c": 2}]')).columns == ["a.b", "c"]
    assert readers.read_any(spark, put(tmp_path / "b.json", '{"a": {"b": 1}}')).count() == 1


def workbook(path):
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="A" sheetId="1" r:id="r1"/><sheet name="B" sheetId="2" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="/xl/worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>item</t></si><si><t>stock</t></si><si><r><t>bo</t></r><r><t>lt</t></r></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="D1" t="inlineStr"><is><t>x</t></is></c></row><row><c r="A2" t="s"><v>2</v></c><c r="B2"><v>5</v></c></row><row><c r="A3" t="inlineStr"><is><t>nut</t></is></c></row></sheetData></worksheet>')
        z.writestr("xl/worksheets/sheet2.xml", f'<worksheet xmlns="{main}"><sheetData><row><c r="A1" t="s"><v>0</v></c></row><row><c r="A2" t="inlineStr"><is><t>cog</t></is></c></row></sheetData></worksheet>')
    return str(path)


def test_xlsx(spark, tmp_path):
    df = readers.read_any(spark, workbook(tmp_path / "w.xlsx"))
    assert df.columns == ["item", "stock", "col_2", "x"] and dict(df.dtypes)["stock"] == "bigint"
    assert sorted((r["item"], r["stock"]) for r in df.collect()) == [("bolt", 5), ("cog", None), ("nut", None)]


def test_xls(spark, tmp_path):
    assert readers.read_any(spark, put(tmp_path / "a.xls", "a,b\n1,2\n")).count() == 1
    (tmp_path / "b.xls").write_bytes(b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1")
    with pytest.raises(ValueError, match="binary"):
        readers.read_any(spark, str(tmp_path / "b.xls"))


def test_unknown_types(spark, tmp_path):
    with pytest.raises(ValueError):
        readers.read_any(spark, "a.docx")
    with pytest.raises(ValueError):
        sinks.write(spark.range(1), str(tmp_path / "a.docx"))
    assert readers.located("s3://b/k.csv") == "s3a://b/k.csv" and readers.located("gs://b/k") == "gs://b/k"


@pytest.mark.parametrize("name", ["o.csv", "o.jsonl", "o.parquet"])
def test_round_trip(spark, tmp_path, name):
    df = synthetic.customers(spark, 200)
    sinks.write(df, str(tmp_path / name))
    assert readers.read_any(spark, str(tmp_path / name)).count() == 200


def test_synthetic_is_a_function_of_the_seed(spark):
    a, b = synthetic.customers(spark, 2000), synthetic.customers(spark.newSession(), 2000)
    assert a.exceptAll(b).count() == 0
    assert a.select("customer_id").distinct().count() < 2000 and a.filter("email is null").count() > 0
    assert synthetic.customers(spark, 100, nested=True).filter("nested is not null").count() > 0


def test_cli(spark, tmp_path):
    put(tmp_path / "a.csv", "id,name,score\n1, Ann ,1.5\n2,Bob,\n3,Cid,2.5\n")
    out = cli.main(["clean", "-i", str(tmp_path / "a.csv"), "-o", str(tmp_path / "out"), "--benchmark", "--enhance-numeric", "--fix-catnum", "--enrich"], spark)
    assert out["summary"]["cleaned_row_count"] == 3 and out["cleaning_details"]["imputed_counts"]["score"] == 1
    assert json.loads((tmp_path / "out/clean_report.json").read_text())["summary"]["original_row_count"] == 3
    assert cli.main(["worker", "-i", str(tmp_path / "a.csv"), "-o", str(tmp_path / "w")], spark)["worker"]["rows_kept"] == 3
    assert cli.main(["profile", "-i", str(tmp_path / "a.csv"), "-o", str(tmp_path / "p")], spark)["stats"]["score"]["median"] == 1.5
    assert cli.main(["generate", "--rows", "10", "--output", str(tmp_path / "g.csv")], spark) == {"rows": 10}


def shout(frames):
    for f in frames:
        yield f.assign(name=f["name"].str.upper())


def test_cli_run_and_flags(spark, tmp_path, monkeypatch):
    put(tmp_path / "a.csv", "id,name,score\n1, Ann ,1.5\n2,Bob,\n3,Cid,2.5\n4,Cid,2.5\n")
    out = cli.main(["run", "-i", str(tmp_path / "a.csv"), "-o", str(tmp_path / "out"), "--debug", "--intensity", "intense", "--enable-llm", "--provider", "test_sources:shout"], spark)
    stats = json.loads((tmp_path / "out/stats_a.json").read_text())
    assert stats["pass1"]["row_count"] == 4 and stats["pass2"]["rows_kept"] == 3 == readers.read_any(spark, str(tmp_path / "out/cleaned_a.csv")).count() and out["worker"]["rows_dropped"] == 1
    assert {r["name"] for r in spark.read.parquet(str(tmp_path / "out/analysed.parquet")).collect()} == {"ANN", "BOB", "CID"}
    assert spark.read.parquet(str(tmp_path / "out/provenance.parquet")).filter("transformation_id = 'exact_duplicate' and confidence_score = 0").count() == 1
    with pytest.raises(SystemExit):
        cli.main(["run", "-i", str(tmp_path / "a.csv"), "-o", str(tmp_path / "x"), "--enable-llm"], spark)


def test_csv_is_split_unless_values_span_lines(spark, tmp_path):
    plain, broken = put(tmp_path / "p.csv", 'a,b\n1,"x ""y"" z"\n'), put(tmp_path / "b.csv", 'a,b\n1,"x\ny"\n')
    assert not readers.broken_lines(spark, plain) and readers.broken_lines(spark, broken)
    assert readers.read_any(spark, plain).first()["b"] == 'x "y" z' and readers.read_any(spark, broken).first()["b"] == "x\ny"


def test_head(spark, tmp_path):
    csv = put(tmp_path / "a.csv", "a,b\n" + "".join(f"{i},x{i}\n" for i in range(50)))
    assert [r["a"] for r in readers.head(spark, csv, 5).collect()] == [0, 1, 2, 3, 4]
    odd = put(tmp_path / "a.txt", "".join(json.dumps({"b": i, "a": "x"}) + "\n" for i in range(9)))
    assert readers.head(spark, odd, 4).columns == ["a", "b"] and readers.head(spark, odd, 4).count() == 4


def test_workbook_is_read_back(spark, tmp_path):
    df = spark.createDataFrame([(1, " a<b ", 1.5), (2, None, None)], "id long, name string, x double")
    sinks.write(df, str(tmp_path / "w.xlsx"))
    back = readers.read_any(spark, str(tmp_path / "w.xlsx"))
    assert dict(back.dtypes) == dict(df.dtypes) and sorted(map(tuple, back.collect())) == [(1, " a<b ", 1.5), (2, None, None)]


def test_repeated_names_in_a_sheet():
    from millrace.sources.xlsx import header

    assert header(["a", "a", None, "a", "b"]) == ["a", "a.1", "col_2", "a.2", "b"]


def test_job_store(spark, tmp_path):
    store = JobStore(spark, str(tmp_path / "meta"))
    assert store.get_job("none") is None
    job = store.create_job("t", "d", {"a": 1})
    store.update_status(job, "pass1_running")
    store.update_status(job, "failed", "boom")
    assert store.get_job(job)["status"] == "failed" and store.get_job(job)["error_message"] == "boom"
    hashes = spark.createDataFrame([("h1", 0), ("h2", 1)], "row_hash string, first_seen_row long")
    store.add_hashes(job, hashes)
    assert store.add_hashes(job, hashes).count() == 0 and store.read("row_hashes").count() == 2
    store.save_stats(job, spark.createDataFrame([("x", 1.0, "m")], "column string, median double, mode string"))
    store.save_stats(job, spark.createDataFrame([("x", 2.0, "m")], "column string, median double, mode string"))
    assert store.stats(job)["x"]["median"] == 2.0
    store.audit(job, "u", "run")
    store.set_quota("t", 5)
    store.set_quota("t", 6)
    store.add_usage("t", "2024-01", 10)
    store.add_usage("t", "2024-01", 5, 2)
    assert store.quota("t")["rows_per_month"] == 6 and store.usage().first()["rows_processed"] == 15
    store.add_samples(job, spark.createDataFrame([("b1", 0, "x"), ("b1", 0, "x"), ("b2", 0, "x")], "bucket_key string, sampled_row_id long, snippet string"))
    assert store.add_samples(job, spark.createDataFrame([("b1", 0, "x"), ("b3", 0, "x")], "bucket_key string, sampled_row_id long, snippet string")).count() == 1
    store.set_progress(job, 0.25)
    store.set_progress(job, 0.5)
    store.remember("k", "v")
    store.remember("old", "v", -1)
    assert store.progress(job) == 0.5 and store.recall("k") == "v" and store.recall("old") is None and store.recall("none") is None
    other = store.create_job("t", "d2")
    assert {"jobs", "row_hashes", "imputation_stats", "audit_logs", "lsh_samples", "job_progress"} == set(store.forget(job))
    assert store.get_job(job) is None and store.read("row_hashes").count() == 0 and store.get_job(other)["status"] == "queued" and store.forget(job) == []
    job = other
    with pytest.raises(ValueError):
        store.update_status(job, "lost")


def test_quickstart(spark, tmp_path):
    import importlib.util
    import os

    path = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "examples", "quickstart.py")
    spec = importlib.util.spec_from_file_location("quickstart", path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    assert module.main(str(tmp_path / "q"), 600, spark)["summary"]["original_row_count"] == 600
