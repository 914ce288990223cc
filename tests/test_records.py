"""Records that go on across lines and splits are those that whole-file parsers find, whatever the splits."""

import csv
import io
import json
import random

import pytest

from millrace.sources import readers, sinks
from millrace.sources import records as R


@pytest.fixture
def splits(spark):
    """Sets how many bytes a split has."""

    def of(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")

    yield of
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def cells(r, n):
    signs = ['"', ",", "\n", "\r\n", "\r", "a", "é", " ", "漢", "b c", '""', "\\"]
    return ["".join(r.choice(signs) for _ in range(r.randrange(1, 9))) for _ in range(n)]


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("size", [37, 400, 1 << 20])
def test_csv(spark, tmp_path, splits, seed, size):
    r = random.Random(seed)
    files = [[[f"x{i}", *cells(r, 2)] for i in range(r.randrange(1, 40))] for _ in range(2)]
    for k, rows in enumerate(files):
        text = io.StringIO(newline="")
        csv.writer(text, lineterminator=r.choice(["\n", "\r\n"])).writerows([["id", "a\nb", "c"], *rows])
        (tmp_path / "t.csv").mkdir(exist_ok=True)
        (tmp_path / "t.csv" / f"{k}.csv").write_bytes(text.getvalue().encode())
    splits(size)
    got = readers.read_csv(spark, str(tmp_path / "t.csv"), infer=False, multi_line=True)
    assert got.columns == ["id", "a\nb", "c"]
    assert sorted(map(tuple, got.collect())) == sorted(tuple(c if c not in readers.NA else None for c in row) for rows in files for row in rows)


def test_csv_splits_are_many_partitions(spark, tmp_path, splits):
    text = "id,note\n" + "".join(f'{i},"line {i}\nnext, with ""quotes"" and a bare \' sign"\n' for i in range(5000))
    (tmp_path / "t.csv").write_text(text)
    splits(16_384)
    got = readers.read_csv(spark, str(tmp_path / "t.csv"))
    assert got.rdd.getNumPartitions() > 10 and dict(got.dtypes)["id"] == "bigint"
    assert {tuple(r) for r in got.collect()} == {(i, f"line {i}\nnext, with \"quotes\" and a bare ' sign") for i in range(5000)}


def test_csv_record_longer_than_splits(spark, tmp_path, splits):
    long = "\n".join(f"line {i}, and" for i in range(400))
    (tmp_path / "t.csv").write_text(f'id,note\n1,a\n2,"{long}"\n3,"b\nc"\n')
    splits(100)
    assert {tuple(r) for r in readers.read_csv(spark, str(tmp_path / "t.csv")).collect()} == {(1, "a"), (2, long), (3, "b\nc")}


def test_csv_stray_quotes_headers_and_blank_lines(spark, tmp_path, splits):
    (tmp_path / "t.csv").write_text('a,,A,b\n\n1,5" pipe,"x\ny",\n\n2,c"d"e,"p""\nq""",NA\n')
    splits(9)
    got = readers.read_csv(spark, str(tmp_path / "t.csv"))
    assert got.columns == ["a", "_c1", "A2", "b"]
    assert {tuple(r) for r in got.collect()} == {(1, '5" pipe', "x\ny", None), (2, 'c"d"e', 'p"\nq"', None)}


def test_csv_empty_and_header_only(spark, tmp_path):
    (tmp_path / "t.csv").write_text('"a\nb",c\n')
    got = readers.read_csv(spark, str(tmp_path / "t.csv"))
    assert got.columns == ["a\nb", "c"] and got.count() == 0
    (tmp_path / "e.csv").write_text("")
    assert readers.read_csv(spark, str(tmp_path / "e.csv"), multi_line=True).count() == 0


def objects(r, n):
    text = lambda: "".join(r.choice(['"', "\\", "{", "}", "[", "]", ",", "\n", "é", "漢", "a"]) for _ in range(r.randrange(9)))
    return [{"k": i, "t": text(), "n": {"u": text(), "v": [text(), {"w": text()}]}} for i in range(n)]


def plain(rows):
    return sorted((o["k"], o["t"], o["n"]["u"], json.dumps(o["n"]["v"][0]), o["n"]["v"][1]["w"]) for o in rows)


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("size", [29, 333, 1 << 20])
@pytest.mark.parametrize("indent", [None, 2])
def test_json_arrays(spark, tmp_path, splits, seed, size, indent):
    r = random.Random(seed)
    files = [objects(r, r.randrange(1, 30)) for _ in range(2)]
    (tmp_path / "t.json").mkdir()
    for k, rows in enumerate(files):
        (tmp_path / "t.json" / f"{k}.json").write_text(json.dumps(rows, ensure_ascii=bool(k), indent=indent) + "\n" * k)
    splits(size)
    got = R.records(spark, str(tmp_path / "t.json"), "json").collect()
    texts = [g["text"].lstrip("[, \n") for g in got]
    want = [o for rows in files for o in rows]
    found = [json.loads(x) for x in texts if "{" in x]
    key = lambda o: json.dumps(o, sort_keys=True)
    assert sorted(map(key, found)) == sorted(map(key, want))
    assert readers.read_json(spark, str(tmp_path / "t.json")).count() == len(want)


def test_json_kinds_of_documents(spark, tmp_path, splits):
    splits(7)
    for k, (text, rows) in enumerate([
        ("[]", []), (" [ ]\n", []), ("", []), ('{"a": {"b": 1}}', [{"a": {"b": 1}}]), ("\ufeff[{}]", [{}]), ('[{"a": [1, {"c": "}]"}]}]', [{"a": [1, {"c": "}]"}]}]),
        ('{"a": 1}\n{"a": 2}\n', [{"a": 1}, {"a": 2}]), ('\n\n[\n{"a": "\\\\"}\n,\n{"a": "\\""}\n]\n\n', [{"a": "\\"}, {"a": '"'}]),
    ]):
        (tmp_path / f"{k}.json").write_text(text)
        got = [json.loads(r["text"].lstrip("\ufeff[, \n")) for r in R.records(spark, str(tmp_path / f"{k}.json"), "json").collect() if "{" in r["text"]]
        assert sorted(map(str, got)) == sorted(map(str, rows)), text


def test_json_broken_documents_show(spark, tmp_path):
    (tmp_path / "t.json").write_text('[{"a": 1}, 7, {"a": 2}, {"a": {"b": ')
    got = readers.read_json(spark, str(tmp_path / "t.json")).cache()
    assert got.filter("a is not null").count() == 1 and got.filter("_corrupt_record is not null").count() == 2


def test_json_round_trip_in_many_tasks(spark, tmp_path, splits):
    rows = spark.range(20_000).selectExpr("id", "named_struct('x', concat('}{', id), 'y', id % 7) as s").repartition(3)
    sinks.write(rows, str(tmp_path / "t.json"))
    docs = [json.loads(p.read_text()) for p in (tmp_path / "t.json").glob("*.txt")]
    assert len(docs) == 3 and sum(map(len, docs)) == 20_000
    splits(50_000)
    got = readers.read_any(spark, str(tmp_path / "t.json"))
    assert R.pieces(spark, str(tmp_path / "t.json"), "json").rdd.getNumPartitions() > 10
    assert got.columns == ["id", "s.x", "s.y"] and got.selectExpr("count(*)", "count(distinct id)", "sum(`s.y`)", "count_if(`s.x` = concat('}{', id))").first() == (20_000, 20_000, sum(i % 7 for i in range(20_000)), 20_000)


def test_empty_table_as_json(spark, tmp_path):
    sinks.write(spark.range(0), str(tmp_path / "t.json"))
    assert readers.read_any(spark, str(tmp_path / "t.json")).count() == 0


def test_array_larger_than_the_memory_of_its_readers(spark, tmp_path, splits):
    """400 MB in one array and one line: no worker ever holds as much, all in all."""
    path, chunk = tmp_path / "t.json", 50_000
    with path.open("w") as f:
        for c in range(16):
            f.write(("," if c else "[") + ",".join(f'{{"k": {c * chunk + i}, "t": "{"x" * 480}"}}' for i in range(chunk)))
        f.write("]")
    splits(16 << 20)

    def peak(batches):
        import resource

        import pyarrow as pa

        rows = sum(b.num_rows for b in batches)
        yield pa.RecordBatch.from_arrays([pa.array([rows]), pa.array([resource.getrusage(resource.RUSAGE_SELF).ru_maxrss])], names=["rows", "kb"])

    got = R.records(spark, str(path), "json").filter("text like '%k%'").select("text").mapInArrow(peak, "rows long, kb long").agg({"rows": "sum", "kb": "max"}).first()
    size = path.stat().st_size
    path.unlink()
    assert got["sum(rows)"] == 16 * chunk and got["max(kb)"] * 1024 < size
