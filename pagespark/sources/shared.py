"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def _qualified(spark: SparkSession, folder: str) -> str:
    """The folder's full address: without a scheme it lies on Spark's default file system, which tasks can't know.

    A context without a JVM knows no file systems: the folder stays as it is named.
    """
    jvm = getattr(spark.sparkContext, "_jvm", None)
    if jvm is None:
        return folder
    path = jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()


def _base(spark: SparkSession) -> str:
    """The folder the session names; a temporary one only where Spark is a single process and none is named."""
    base = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"name a folder that all executors share in {CHECKPOINT_DIR}")
        base = f"file://{tempfile.mkdtemp(prefix='pagespark-')}"
        spark.sparkContext.setCheckpointDir(base)
    return f"{_qualified(spark, base).rstrip('/')}/pagespark/{spark.sparkContext.applicationId}"


def shared_folder(spark: SparkSession) -> str:
    """A new folder for this application's intermediate tables."""
    return f"{_base(spark)}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """Compute a frame once and keep it as a table in the shared folder.

    For results that several branches of a plan read and that come out of a Python kernel: the
    kernel runs once, and the table outlives lost executors.
    """
    path = f"{shared_folder(df.sparkSession)}/table"
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._written_to = path
    return table


def remove(*tables: DataFrame) -> None:
    """Remove tables that ``written`` returned and no frame reads any more."""
    for table in tables:
        _delete(table.sparkSession, table._written_to.rsplit("/", 1)[0])


def drop_intermediate(spark: SparkSession) -> None:
    """Remove all intermediate tables of this application; frames that read them can no longer run."""
    _delete(spark, _base(spark))


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
