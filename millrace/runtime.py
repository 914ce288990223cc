"""What every plan needs from its session: tables, worker imports, lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """One table of a data folder, by any path that Spark can read."""
    return spark.read.parquet(f"{base.rstrip('/')}/{name}.parquet")


def share_code(spark: SparkSession) -> None:
    """Let Python workers import this package even if only the driver's sys.path has it."""
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "")
    if ROOT not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, have) if x)


def spread(df: DataFrame) -> DataFrame:
    """df over at least as many partitions as there are cores, for work that takes far longer than a read.

    Only a table of fewer splits than cores is dealt out, by Catalyst's estimate
    of its size and without a job; a larger one stays as it is read.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * split else df


def shared(spark: SparkSession) -> str:
    """The folder that all executors share: the session's spark.checkpoint.dir.

    A session of one machine without one (a test) gets a temporary folder; on a
    cluster that is an error, as executors would not see each other's files.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context._jsc.sc().isLocal():
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="millrace-"))
    return context._jsc.sc().getCheckpointDir().get()


def scratch(spark: SparkSession) -> str:
    """A new folder within the shared one."""
    return f"{shared(spark)}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Compute df once and cut its lineage with a checkpoint in the shared folder.

    The estimates of df's size are left behind with its lineage: those of an
    iteration would multiply from round to round until planning fails.
    """
    spark = df.sparkSession
    shared(spark)
    done = df.checkpoint(eager=True)._jdf
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(done.queryExecution().toRdd(), done.schema(), False), spark)
