"""Small files and folders through Spark's file systems."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    context = spark.sparkContext
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(context._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    target, system = _at(spark, path)
    return system.exists(target)


def make(spark: SparkSession, path: str) -> None:
    target, system = _at(spark, path)
    system.mkdirs(target)


def children(spark: SparkSession, path: str) -> list[str]:
    """The folders within a folder; none if it is not there."""
    target, system = _at(spark, path)
    return [s.getPath().toString() for s in system.listStatus(target) if s.isDirectory()] if system.exists(target) else []


def delete(spark: SparkSession, path: str) -> bool:
    target, system = _at(spark, path)
    return system.delete(target, True)


def move(spark: SparkSession, source: str, target: str) -> None:
    """A folder under another name, in one step; an error if it cannot be."""
    origin, system = _at(spark, source)
    if not system.rename(origin, _at(spark, target)[0]):
        raise OSError(f"{source} cannot be moved to {target}")


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file as text; None if it is not there."""
    target, system = _at(spark, path)
    if not system.exists(target):
        return None
    stream = system.open(target)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_bytes(spark: SparkSession, path: str, content: bytes) -> None:
    target, system = _at(spark, path)
    stream = system.create(target, True)
    try:
        stream.write(bytearray(content))
    finally:
        stream.close()


def replace_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file written anew: whole under another name first, then moved over the old one in one step."""
    write_bytes(spark, f"{path}.new", text.encode())
    source, system = _at(spark, f"{path}.new")
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    how = getattr(jvm, "Options$Rename").OVERWRITE
    options = spark.sparkContext._gateway.new_array(getattr(jvm, "Options$Rename"), 1)
    options[0] = how
    files = jvm.FileContext.getFileContext(system.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    files.rename(system.makeQualified(source), system.makeQualified(_at(spark, path)[0]), options)
