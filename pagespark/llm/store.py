"""Tables that several steps of an operator read, kept in the folder that all executors share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagespark.sources.shared import remove
from pagespark.sources.shared import shared_folder as shared
from pagespark.sources.shared import written as kept

__all__ = ["fresh", "kept", "others", "remove", "row_key", "shared", "table"]


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """A number for a row's id and text: rows that share an id but not a text stay apart."""
    return F.xxhash64(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.coalesce(text, F.lit("")), F.col(doc_id).isNull())


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that the frame does not have, whatever their case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def others(df: DataFrame, *names: str) -> list[str]:
    """Columns of the frame that bear none of these names, whatever their case."""
    taken = {name.lower() for name in names}
    return [c for c in df.columns if c.lower() not in taken]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
