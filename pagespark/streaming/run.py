"""Run a bounded stream to its end, into a table in the shared folder."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from pagespark.sources.shared import shared_folder


@contextmanager
def session_conf(spark: SparkSession, conf: dict[str, str]):
    """Settings for queries started inside the block; a streaming query keeps a copy of them."""
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def run_available(stream: DataFrame, conf: dict[str, str] | None = None, partitions: int | None = None) -> DataFrame:
    """Process all input that is there now, and return the rows that were emitted.

    ``partitions`` is the number of state partitions, for a stream whose state needs fewer or more
    than the session's shuffles.
    """
    spark = stream.sparkSession
    folder = shared_folder(spark)
    own = {"spark.sql.shuffle.partitions": str(partitions)} if partitions else {}
    with session_conf(spark, {**own, **(conf or {})}):
        query = (
            stream.writeStream.format("parquet")
            .option("path", f"{folder}/rows")
            .option("checkpointLocation", f"{folder}/state")
            .outputMode("append")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")
