"""Hashed byte n-grams of texts, and bounded samples of rows to fit a model on."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_MULTIPLY = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)


def ngram_ids(data: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Bucket of every run of ``n`` bytes, of ``2 ** bits`` buckets."""
    m = len(data) - n + 1
    if m <= 0:
        return np.empty(0, np.uint32)
    wide = data.astype(np.uint32)
    total = np.full(m, n * 0x632BE5AB & 0xFFFFFFFF, np.uint32)
    for j in range(n):
        total += wide[j : j + m] * _MULTIPLY[j]
        total ^= total >> np.uint32(15)
        total *= np.uint32(0x2C1B3C6D)
    return total >> np.uint32(32 - bits)


def stratified(rows: DataFrame, key: str, group: str, per_group: int, most: int) -> DataFrame:
    """At most ``per_group`` keys of each group and ``most`` in all, by a hash of the key.

    ``most`` is shared out evenly: where it cuts, each group's first keys stay before any group's later ones.

    Groups are counted first, so that of a large one only about twice the bound moves to be ranked.
    """
    from pyspark.sql import Window

    order = F.xxhash64(F.col(key).cast("string"))
    n = rows.groupBy(F.col(group).alias("_group")).agg(F.count("*").alias("_n"))
    share = (order.bitwiseAND((1 << 31) - 1)).cast("double") / (1 << 31)
    near = rows.join(n, F.col(group) == F.col("_group")).where(share * F.col("_n") <= 2 * per_group + 100)
    rank = F.row_number().over(Window.partitionBy(group).orderBy(order, key))
    ranked = near.withColumn("_rank", rank).where(F.col("_rank") <= per_group)
    return ranked.orderBy("_rank", order, key).limit(most).select(*rows.columns)
