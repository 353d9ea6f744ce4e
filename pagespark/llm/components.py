"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagespark.llm.store import kept, remove


def _print(edges: DataFrame) -> tuple:
    """Count and order-free checksum of a table of edges."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """Columns ``u`` and ``v`` of ``links`` are joined ends; returns each end but the smallest of its
    component as ``u`` with that smallest one as ``v``.

    Every step replaces edges by edges to the smallest neighbour, combined before they move; a
    hub's edges are joined to its one smallest neighbour, a join that Spark can split. Each step is
    a table in the shared folder, so no lineage grows and no edge reaches the driver; the table before
    it goes once it is written. The number of steps grows with the logarithm of a component's length.
    """
    greatest, least = F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    edges = kept(links.where("u <> v").select(greatest, least).distinct())
    before = _print(edges)
    while before[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = kept(large.where("u <> v").distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.union(low.select("u", F.col("m").alias("v")))
        done, edges = (edges, large), kept(small.select(greatest, least).distinct())
        remove(*done)
        after = _print(edges)
        if after == before:
            break
        before = after
    return edges
