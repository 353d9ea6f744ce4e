"""Neighbours in an order, found without sorting all rows of a key in one place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

BUCKETS = ("minute", "day")


def neighbours(
    df: DataFrame, keys: list[str], current: str, at: Column, buckets: tuple[str, ...] = BUCKETS, distinct: bool = False
) -> DataFrame:
    """Add ``newer`` and ``older``: what the rows next to it hold in ``current``, a struct that orders a key's rows.

    A key may hold most rows. Rows first meet inside their finest time bucket of ``at``. What has no neighbour
    there is a bucket's newest and oldest row; these meet in the next coarser bucket, at last within the key,
    while all others sort among the rows of their own fine bucket. One scan and one exchange for each level.
    ``distinct`` drops repeated rows inside the first level.
    """
    fine, levels = "_fine", [*buckets[1:], None] if buckets else []
    df = df.withColumn(fine, F.date_trunc(buckets[0], at) if buckets else F.lit(None).cast("timestamp"))
    if distinct:
        df = df.repartition(*keys, fine).dropDuplicates([*keys, fine, current])

    def next_to(df: DataFrame, parts: list[Column], end: Column | None) -> DataFrame:
        w = W.partitionBy(*parts).orderBy(F.desc(current))
        found = {"older": F.lead(current).over(w), "newer": F.lag(current).over(w)}
        if end is not None:
            df = df.withColumns({f"_{k}": v for k, v in found.items()})
            found = {k: F.coalesce(k, f"_{k}") for k in found}
        return df.withColumns(found).drop("_older", "_newer")

    df = next_to(df, [*map(F.col, keys), F.col(fine)], None)
    for level in levels:
        end = F.col("older").isNull() | F.col("newer").isNull()
        among = [] if level is None else [F.date_trunc(level, at)]
        df = next_to(df, [*map(F.col, keys), *among, F.when(~end, F.col(fine))], end)
    return df.drop(fine)
