"""Exact top-k search by inner product without random access (NRA).

Each dimension is a list of (vector, value) sorted by value; a query reads it downwards where its
own component is positive and upwards where it is negative, so what it gets only falls. After a
depth, a candidate's score lies between two bounds: what was read of it, plus for each list in which
it has not come up yet the list's last contribution (lower) or the one just read (upper). A
query stops when no candidate outside can pass: its upper bound is under the k-th best lower bound.
For the candidates left, the rest of their lists is read out, which gives their final scores.

Vectors are dealt to blocks by a hash, queries to groups; each (block, group) is one task's work. All
queries of a group read a block's lists together: the sums over what has been read are products of
the block's matrix, emptied where a list has not come that far, with the queries' components. The k
best of each block meet once more by query, cut to k before they move.

Components are floor(256 * x). Defined results: vectors that are null, empty or hold a null or a
component that is not finite take no part, nor do rows without an id. Scores are exact: a block whose sums
could pass 2 ** 53 is searched by products with error bounds, and Python integers settle what these leave open. Scores
beyond 64 bits are given as the largest or smallest such number, and tie there; a component that is not finite once
it is multiplied by 256 counts as not finite. Only vectors of the query's own length are candidates, never rows of its
own id. Rows that repeat an id are candidates of their own; as
queries, rows of equal id and vector are one. Equal scores go to the smaller id, equal
vectors tie. Fewer than k candidates: all of them. Extra columns are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS, GROUP_ROWS = 2048, 512
#: Depths, as shares of a list, after which bounds are compared.
DEPTHS = (0.5, 0.75, 0.9, 1.0)
#: A query also stops when so few candidates are left for each of its k.
LEFT = 20
#: Whole numbers up to this are exact in float64.
_EXACT = float(1 << 53)
_LONG = (1 << 63) - 1


def search_block(vectors: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, vector row, score) of each query's k best in a block; integers in float64."""
    n, _ = vectors.shape
    order = np.argsort(vectors, axis=0, kind="stable")
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(n)[:, None], axis=0)
    sorted_ = np.take_along_axis(vectors, order, axis=0)
    up, down = np.minimum(queries, 0), np.maximum(queries, 0)
    least = down @ sorted_[0] + up @ sorted_[-1]  # every list's last contribution
    open_, out = np.arange(len(queries)), []
    for share in DEPTHS:
        depth = min(n, max(1, int(np.ceil(share * n))))
        from_top, from_low = rank >= n - depth, rank < depth
        top, low = sorted_[n - depth], sorted_[depth - 1]  # where the lists stand
        d, u = down[open_], up[open_]
        read = (vectors * from_top) @ d.T + (vectors * from_low) @ u.T
        # what was read replaces the list's last contribution, or its present one
        floor = read + least[open_] - from_top @ (d * sorted_[0]).T - from_low @ (u * sorted_[-1]).T
        ceiling = read + (d @ top + u @ low) - from_top @ (d * top).T - from_low @ (u * low).T
        own = ids[:, None] == query_ids[open_][None, :]
        floor[own] = ceiling[own] = -np.inf
        kth = np.partition(floor, n - k, axis=0)[n - k] if n > k else np.full(len(open_), -np.inf)
        inside = (ceiling >= kth) & (ceiling > -np.inf)
        few = (inside.sum(axis=0) <= LEFT * k) | (depth == n)
        for j in np.flatnonzero(few):
            rows = np.flatnonzero(inside[:, j])
            final = vectors[rows] @ queries[open_[j]]
            best = rows_best(final, ids[rows], k)
            out.append((np.full(len(best), open_[j]), rows[best], final[best]))
        open_ = open_[~few]
        if not len(open_):
            break
    if not out:
        return np.empty(0, int), np.empty(0, int), np.empty(0)
    return tuple(np.concatenate(x) for x in zip(*out))


def search_large(vectors: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """``search_block`` for components whose products float64 can't hold; whole numbers in, Python integers out."""
    distinct, group = np.unique(vectors, axis=0, return_inverse=True)
    group, whole = group.ravel(), [None] * len(distinct)
    near, size = distinct @ queries.T, np.abs(distinct) @ np.abs(queries).T
    slack = size * (4 * (vectors.shape[1] + 2) / _EXACT)  # more than rounding can make of the sum
    out: tuple[list, list, list] = ([], [], [])
    for j in range(len(queries)):
        rows = np.flatnonzero(ids != query_ids[j])
        floor, ceiling = ((near[:, j] + s * slack[:, j])[group[rows]] for s in (-1, 1))
        kth = np.partition(floor, len(rows) - k)[len(rows) - k] if len(rows) > k else -np.inf
        asked, score = [int(x) for x in queries[j]], {}
        for g in np.unique(group[rows[ceiling >= kth]]).tolist():
            whole[g] = whole[g] or [int(x) for x in distinct[g]]
            score[g] = sum(a * b for a, b in zip(whole[g], asked))
        found = sorted((-score[g], i, r) for g, i, r in zip(group[rows].tolist(), ids[rows].tolist(), rows.tolist()) if g in score)[:k]
        out[0].extend([j] * len(found))
        out[1].extend(r for _, _, r in found)
        out[2].extend(-s for s, _, _ in found)
    return np.array(out[0], int), np.array(out[1], int), out[2]


def rows_best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, ties to the smaller id."""
    return np.lexsort((ids, -score))[:k]


def _block(k: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        asks = table["asks"].to_numpy(zero_copy_only=False)
        ids = table["vec_id"].to_numpy()
        dim = table["dim"][0].as_py()
        flat = table["vec"].combine_chunks().flatten().to_numpy().astype(np.float64).reshape(-1, dim)
        pick = np.flatnonzero(~asks)
        q = np.flatnonzero(asks)
        if not len(pick) or not len(q):
            found = (np.empty(0, int), np.empty(0, int), np.empty(0))
        else:
            # search_block adds up four sums of products
            most = 4 * dim * float(np.abs(flat[pick]).max()) * float(np.abs(flat[q]).max())
            found = (search_block if most < _EXACT else search_large)(flat[pick], ids[pick], flat[q], ids[q], k)
        row = table["row"].to_numpy()
        return pa.table({"query_id": ids[q][found[0]], "query_row": row[q][found[0]], "vec_id": ids[pick][found[1]], "score": pa.array([min(max(int(x), -_LONG - 1), _LONG) for x in found[2]], pa.int64())})

    return run


def usable(vectors: DataFrame, vec: str = "embedding") -> DataFrame:
    """vec_id and whole components ``vec``, as doubles that hold them exactly, of the vectors that take part."""
    x = F.col(vec)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double") * 256) == F.lit(float("inf"))))
    # doubles from 2 ** 53 are whole, and floor() ends at 64 bits
    floor = lambda y: F.when(F.abs(y) < _EXACT, F.floor(y).cast("double")).otherwise(y)
    whole = F.transform(x, lambda v: floor(v.cast("double") * 256))
    return vectors.where(F.col("vec_id").isNotNull() & x.isNotNull() & (F.size(x) > 0) & ~bad).select("vec_id", whole.alias("vec"))


def search(vectors: DataFrame, asks: Column, k: int = 5, vec: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all rows for the rows that ``asks`` picks."""
    base = usable(vectors, vec).withColumn("dim", F.size("vec")).withColumn("row", F.xxhash64("vec_id", "vec"))
    n, n_asks = base.agg(F.count("*"), F.count_if(asks)).first()
    blocks, groups = max(1, -(-n // BLOCK_ROWS)), max(1, -(-n_asks // GROUP_ROWS))
    spread = lambda parts: F.pmod(F.xxhash64("row", F.lit(parts)), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    side = base.select("*", F.lit(False).alias("asks"), spread(blocks).alias("block")).withColumn("group", every(groups))
    ask = base.where(asks).dropDuplicates(["vec_id", "row"])
    ask = ask.select("*", F.lit(True).alias("asks"), spread(groups).alias("group")).withColumn("block", every(blocks))
    found = side.unionByName(ask).groupBy("dim", "block", "group").applyInArrow(_block(k), "query_id long, query_row long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id", "query_row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
