"""One reader for all file formats, by any path that Spark can open (local, s3a, gs, abfss)."""

from __future__ import annotations

import csv
import io

from millrace.operators.shape import flatten
from millrace.sources.records import records
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts that stand for a missing value in CSV files.
NA = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
SCHEMES = {"s3": "s3a"}


def located(path: str) -> str:
    """The path under the scheme that Hadoop's file systems use."""
    scheme, found, rest = path.partition("://")
    return f"{SCHEMES.get(scheme, scheme)}://{rest}" if found else path


def suffix(path: str) -> str:
    name = path.rstrip("/").rsplit("/", 1)[-1].lower()
    return name.rsplit(".", 1)[-1] if "." in name else ""


def read_any(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """A file or folder by its suffix; one global schema, nested JSON flattened.

    strict: whether a malformed JSON line is an error; lenient reading skips it
    and leaves rows nested.
    """
    path, kind = located(path), suffix(path)
    if kind in ("csv", "txt"):
        return read_csv(spark, path)
    if kind in ("jsonl", "ndjson"):
        return read_jsonl(spark, path, strict)
    if kind == "json":
        return sorted_columns(flatten(read_json(spark, path)))
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind == "xlsx":
        return read_xlsx(spark, path)
    if kind == "xls":
        return read_xls(spark, path)
    raise ValueError(f"unsupported file type: {path}")


def sorted_columns(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in sorted(df.columns)])


def read_csv(spark: SparkSession, path: str, infer: bool = True, multi_line: bool | None = None) -> DataFrame:
    """CSV with a header; the usual spellings of a missing value are null.

    Large files are split among tasks. multi_line: whether quoted values may hold
    line ends, so that records are told by the state of quotes (see records); by
    default the files are searched for such values, up to the first one.
    """
    multi_line = broken_lines(spark, path) if multi_line is None else multi_line
    raw = _quoted(spark, path) if multi_line else spark.read.option("header", True).option("escape", '"').csv(path)
    known = raw.select(*[F.when(~F.col(f"`{c}`").isin(NA), F.col(f"`{c}`")).alias(c) for c in raw.columns])
    return typed(known) if infer else known


def _quoted(spark: SparkSession, path: str) -> DataFrame:
    """CSV files whose quoted values hold line ends, as text columns; each file's first record is its header, the first file's names the columns."""
    found = records(spark, path, "csv").withColumn("text", F.regexp_replace("text", r"(\r\n|\r|\n)\z", ""))
    head = found.filter("first").select("text").first()
    if head is None:
        return spark.read.option("header", True).csv(path)
    names, seen = next(csv.reader(io.StringIO(head["text"].removeprefix("\ufeff"), newline=""))), set()
    for i, name in enumerate(names):
        names[i] = f"_c{i}" if not name else f"{name}{i}" if name.lower() in seen else name
        seen.add(name.lower())
    cells = F.from_csv("text", ", ".join(f"c{i} string" for i in range(len(names))), {"escape": '"', "multiLine": "true"})
    return found.filter(~F.col("first")).select(cells.alias("r")).select(*[F.col(f"r.c{i}").alias(n) for i, n in enumerate(names)])


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """JSON documents: the objects of an array, or an object alone, each a row; read in as many tasks as a file has splits.

    Text that is in no object, such as a number in the array or the rest of a
    document that breaks off, is a row of its own under _corrupt_record.
    """
    bare = F.regexp_replace("text", r"\A[\s,\x{FEFF}]*(\[[\s,]*)?", "")
    texts = records(spark, path, "json").filter(~F.col("text").rlike(r"\A[\s,\[\]\x{FEFF}]*}?\z")).select(bare.alias("value"))
    encoder = spark._jvm.org.apache.spark.sql.Encoders.STRING()
    return DataFrame(spark.read._jreader.json(getattr(texts._jdf, "as")(encoder)), spark)


def broken_lines(spark: SparkSession, path: str) -> bool:
    """Whether a line of a CSV has an odd number of quotes, so that a quoted value goes on in the next."""
    lines = spark.read.text(path)
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return not lines.filter(quotes % 2 == 1).isEmpty()


def typed(df: DataFrame) -> DataFrame:
    """Text columns as long or double where all values read so; one pass over the data."""
    if not df.columns:
        return df
    long, double = r"^\s*[+-]?\d{1,18}\s*$", r"^\s*[+-]?((\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?|inf|Infinity)\s*$"
    fits = [F.coalesce(F.bool_and(F.col(f"`{c}`").rlike(p)), F.lit(False)).alias(f"{k}{i}") for i, c in enumerate(df.columns) for k, p in (("l", long), ("d", double))]
    row = df.agg(*fits).first()
    kind = lambda i: "long" if row[f"l{i}"] else "double" if row[f"d{i}"] else None
    return df.select(*[(F.trim(F.col(f"`{c}`")).try_cast(kind(i)) if kind(i) else F.col(f"`{c}`")).alias(c) for i, c in enumerate(df.columns)])


def read_jsonl(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """JSON lines. Strict: a bad line fails and rows are flattened; lenient: bad lines are skipped."""
    if not strict:
        return spark.read.option("mode", "DROPMALFORMED").json(path)
    return sorted_columns(flatten(spark.read.option("mode", "FAILFAST").json(path)))


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """All sheets of a workbook, a task a sheet; cells are text, then typed."""
    from millrace.sources.xlsx import WorkbookSource

    spark.dataSource.register(WorkbookSource)
    return typed(spark.read.format("workbook").load(path))


def read_xls(spark: SparkSession, path: str) -> DataFrame:
    """An .xls that is CSV in truth; the binary format is not supported."""
    first = spark.read.format("binaryFile").load(path).select(F.substring("content", 1, 8).alias("h")).first()
    if first and bytes(first["h"]).startswith(b"\xd0\xcf\x11\xe0"):
        raise ValueError(f"binary .xls workbooks are not supported, save as .xlsx: {path}")
    return read_csv(spark, path)


def head(spark: SparkSession, path: str, rows: int = 2000) -> DataFrame:
    """The first rows of a file as CSV, or as JSON lines if its first line is an object; only these rows are parsed."""
    lines = [r["value"] for r in spark.read.text(located(path)).limit(rows + 1).collect()]
    if lines and lines[0].lstrip().startswith("{"):
        return sorted_columns(spark.read.option("mode", "DROPMALFORMED").json(spark.sparkContext.parallelize(lines[:rows], 1)))
    raw = spark.read.option("header", True).option("escape", '"').csv(spark.sparkContext.parallelize(lines, 1))
    return typed(raw.select(*[F.when(~F.col(f"`{c}`").isin(NA), F.col(f"`{c}`")).alias(c) for c in raw.columns]))
