"""Best-fit packing of documents into fixed-length training sequences, with conflicts.

A sequence (bin) holds ``capacity`` units of length. Two pieces conflict when they come from one
source or one duplicate cluster; a bin never holds two that conflict. Documents longer than a bin
are cut: full pieces fill a bin alone, the rest is packed like any other piece.

Pieces go to bins in order of falling length. Open bins stand in order of what they have left, each
with two 64-bit bitmaps: of the sources and of the clusters inside (a source or cluster sets one
bit by its hash). The successor search starts at the tightest bin that has room and walks on until
a bin is compatible: bits that do not meet prove it, where they meet the bin's own short lists
decide. So the bin found is the tightest compatible one; without any, a new bin opens.

Documents are dealt by a hash of their row to parts of about ``part_rows`` each, which are packed
apart: a source or cluster with a third of all rows spreads over all parts like any other, and
since conflicts are only forbidden inside a bin, parts need to know nothing of each other. A part's
loose bins are its only loss, a few in thousands. The number of parts follows the number of rows.

Defined results: a null length counts as 0 and a length of 0 as a piece of 0 that takes a place in
a bin and no room. A null source or cluster conflicts with nothing. Rows that repeat an id are
packed one by one; if they share a cluster they part. An empty table gives no rows. Extra columns are
left out; what returns is doc_id, piece, n_pieces, bin, start (in the bin), length.
"""

from __future__ import annotations

from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagespark.llm.store import row_key

CAPACITY = 4096
PART_ROWS = 4096
SCHEMA = "doc_id long, piece long, n_pieces long, bin string, start long, length long"
_NEAR = 64


class Bins:
    """Open bins in order of the room left (then of age), for best fit under conflicts."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.count, self.open = capacity, 0, 0
        self.room, self.sources, self.clusters, self.bin = (np.zeros(256, t) for t in (np.int64, np.uint64, np.uint64, np.int64))
        self.inside: list[tuple[set, set]] = []

    def _move(self, i: int, at: int) -> None:
        """Put the entry of place ``i`` at place ``at`` (at <= i), the ones between move up by one."""
        for a in (self.room, self.sources, self.clusters, self.bin):
            value = a[i]
            a[at + 1 : i + 1] = a[at:i].copy()
            a[at] = value

    def _find(self, need: int, source: int, cluster: int) -> int:
        bit_s, bit_c = _bit(source), _bit(cluster)
        i, step = int(np.searchsorted(self.room[: self.open], need, "left")), _NEAR
        while i < self.open:
            j = min(self.open, i + step)
            meet = ((self.sources[i:j] & bit_s) | (self.clusters[i:j] & bit_c)) != 0
            free = int(np.argmin(meet))
            last = free if not meet[free] else j - i
            for k in np.flatnonzero(meet[:last]):
                own = self.inside[self.bin[i + k]]
                if source not in own[0] and cluster not in own[1]:
                    return i + int(k)
            if last < j - i:
                return i + last
            i, step = j, step * 2
        return -1

    def put(self, need: int, source: int, cluster: int) -> tuple[int, int]:
        """Bin and start of a piece."""
        i = self._find(need, source, cluster)
        if i < 0:
            if self.open == len(self.room):
                self.room, self.sources, self.clusters, self.bin = (np.concatenate([a, np.zeros_like(a)]) for a in (self.room, self.sources, self.clusters, self.bin))
            i = self.open
            self.room[i], self.sources[i], self.clusters[i], self.bin[i] = self.capacity, 0, 0, self.count
            self.inside.append((set(), set()))
            self.open += 1
            self.count += 1
        number, start = int(self.bin[i]), int(self.capacity - self.room[i])
        self.room[i] -= need
        self.sources[i] |= _bit(source)
        self.clusters[i] |= _bit(cluster)
        for value, own in zip((source, cluster), self.inside[number]):
            if value:
                own.add(value)
        self._move(i, int(np.searchsorted(self.room[:i], self.room[i], "right")))
        return number, start


def _bit(value: int) -> np.uint64:
    return np.uint64(1) << np.uint64(value & 63) if value else np.uint64(0)


def pack_part(part: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """Pack the documents (row, doc_id, known, length, source, cluster; 0 is no source or cluster) of one part."""
    rows, pieces, bins = [], [], Bins(capacity)
    for k, length in enumerate(part["length"].tolist()):
        full, rest = divmod(length, capacity)
        n = full + (rest > 0 or not full)
        rows += [(k, p, n, capacity) for p in range(full)]
        if n > full:
            pieces.append((k, full, n, rest))
    source, cluster, row = (part[c].tolist() for c in ("source", "cluster", "row"))
    pieces.sort(key=lambda x: (-x[3], row[x[0]]))
    placed = [(k, p, n, length, *bins.put(length, source[k], cluster[k])) for k, p, n, length in pieces]
    # bins that one full piece fills follow the others
    placed += [(k, p, n, length, bins.count + i, 0) for i, (k, p, n, length) in enumerate(rows)]
    out = pd.DataFrame(placed, columns=["k", "piece", "n_pieces", "length", "bin", "start"])
    out["doc_id"] = part["doc_id"].to_numpy()[out["k"]]
    out["known"] = part["known"].to_numpy()[out["k"]]
    return out


def pack(docs: DataFrame, length: str = "length", source: str = "source", cluster: str = "cluster", row: str | None = None, capacity: int = CAPACITY, part_rows: int = PART_ROWS, rows: int | None = None) -> DataFrame:
    """Bins for all pieces of ``docs``: columns doc_id, piece, n_pieces, bin, start, length.

    ``cluster`` may be null (a document without copies). ``row`` names a number that tells rows apart;
    without one it is made of doc_id and text. ``rows`` is the number of documents, where a caller knows it.
    """
    items = docs.select(
        F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNotNull().alias("known"), (F.col(row) if row else row_key()).cast("long").alias("row"),
        F.greatest(F.coalesce(F.col(length).cast("long"), F.lit(0)), F.lit(0)).alias("length"),
        F.coalesce(F.when(F.col(source).isNotNull(), F.xxhash64(source)), F.lit(0)).alias("source"),
        F.coalesce(F.when(F.col(cluster).isNotNull(), F.xxhash64(cluster)), F.lit(0)).alias("cluster"),
    )
    n = docs.select("doc_id").count() if rows is None else rows
    parts = max(1, -(-n // part_rows))
    items = items.withColumn("part", F.pmod(F.xxhash64("row", "doc_id"), F.lit(parts)))

    def run(key: tuple[Any, ...], part: pd.DataFrame) -> pd.DataFrame:
        out = pack_part(part.sort_values(["row", "doc_id"], kind="stable").reset_index(drop=True), capacity)
        out["bin"] = f"{key[0]}-" + out["bin"].astype(str)
        out["doc_id"] = out["doc_id"].astype("Int64").where(out["known"])
        return out[["doc_id", "piece", "n_pieces", "bin", "start", "length"]]

    return items.groupBy("part").applyInPandas(run, SCHEMA)
