"""A bit map of keys, small enough to broadcast, that a scan asks before its wide rows move.

``key_filter`` marks one bit for each key (a hash of its columns) in ``buckets`` maps of 32,768 bits, 4 KB
each, built by partial aggregates. ``might_hold`` keeps the rows whose bit is set: all rows of the keys, and
as many others as bits are shared (1 in 8 where keys are an eighth of the bits). The exact join comes after.
Its size is ``buckets`` times 4 KB whatever the number of keys; when keys fill the map, more rows pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 8 MB, 67 million bits.
BUCKETS = 2048
_BITS = 32768


def _place(columns: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(buckets * _BITS).cast("long"))


def key_filter(keys: DataFrame, columns: list[str], buckets: int = BUCKETS) -> DataFrame:
    """_bucket, _bits: the map of the keys of a frame."""
    placed = keys.select(_place(columns, buckets).alias("_place"))
    bucket, bit = F.floor(F.col("_place") / _BITS).cast("int"), F.col("_place") % _BITS
    return placed.groupBy(bucket.alias("_bucket")).agg(F.bitmap_construct_agg(bit).alias("_bits"))


def might_hold(df: DataFrame, marked: DataFrame, columns: list[str], buckets: int = BUCKETS) -> DataFrame:
    """Rows whose key may be marked, by a broadcast of the map."""
    place = df.withColumn("_place", _place(columns, buckets)).withColumn("_bucket", F.floor(F.col("_place") / _BITS).cast("int"))
    at = (F.col("_place") % _BITS).cast("int")
    byte = F.conv(F.hex(F.substring("_bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    return place.join(F.broadcast(marked), "_bucket").filter(F.getbit(byte, at % 8) == 1).drop("_place", "_bucket", "_bits")
