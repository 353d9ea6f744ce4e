"""A session with the settings this package works best with."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # pages are large rows: small Arrow batches keep Python workers small
    "spark.sql.execution.arrow.maxRecordsPerBatch": "512",
    # sessions of a busy key merge before the shuffle
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
    # per-page lists are many small aggregation buffers: keep hashing them instead of sorting
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "65536",
    # plans here have thousands of expressions; recording a call site for each takes longer than building it
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def session(name: str, cores: int, memory: str = "12g") -> SparkSession:
    """A local session; on a cluster, pass ``SETTINGS`` to the submitted job instead."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    builder = builder.config("spark.driver.memory", memory).config("spark.sql.shuffle.partitions", str(cores))
    # local test tables are single files
    builder = builder.config("spark.pagespark.kernelPartitions", str(cores))
    for k, v in SETTINGS.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
