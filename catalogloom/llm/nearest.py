"""Nearest neighbours by a block matrix join.

Queries and candidates are dealt into blocks; each pair of blocks is a tile. In a tile all products
are taken on vectors rounded to 8-bit integers. Rounding errors are known per vector, which bounds
each product from both sides; only pairs that can still be among the nearest are computed again in
double precision. Heaps keep the nearest per query within a tile, a rank merges the tiles.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .blocks import whole_groups
from .common import Arrow, stored
from .embedding_dedup import matrix, unit, usable, vectors_of


def rounded(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit rows as 8-bit integers (held as floats, whose products are exact), scales, rounding errors."""
    scale = np.abs(rows).max(axis=1, keepdims=True) / 127
    whole = np.rint(rows / scale).astype(np.int8)
    error = np.sqrt(((rows - whole * scale) ** 2).sum(axis=1))
    return whole.astype(np.float32), scale[:, 0], error + 1e-6


def _tile(ids: np.ndarray, rows: np.ndarray, queries: np.ndarray, candidates: np.ndarray, k: int, strip: int) -> list[tuple[int, int, float]]:
    units = unit(rows)
    norms = np.sqrt(np.cumsum(rows * rows, axis=1)[:, -1])
    whole, scale, error = rounded(units)
    heaps: list[list[tuple[float, int]]] = [[] for _ in queries]
    for at in range(0, len(candidates), strip):
        c = candidates[at : at + strip]
        product = (whole[queries] @ whole[c].T).astype(np.float64) * scale[queries][:, None] * scale[c]
        bound = error[queries][:, None] + (1 + error[queries])[:, None] * error[c]
        own = ids[queries][:, None] == ids[c]
        low, high = np.where(own, -np.inf, product - bound), np.where(own, -np.inf, product + bound)
        kth = np.partition(low, -k, axis=1)[:, -k] if low.shape[1] > k else np.full(len(queries), -np.inf)
        held = np.array([h[0][0] if len(h) == k else -np.inf for h in heaps])  # the worst of k already found
        reach = high >= np.maximum(kth, held)[:, None]
        for q, j in zip(*np.nonzero(reach & ~own)):
            x, y = queries[q], c[j]
            score = float(np.cumsum(rows[x] * rows[y])[-1] / (norms[x] * norms[y]))  # summed in order
            entry = (score, -int(ids[y]))
            if len(heaps[q]) < k:
                heapq.heappush(heaps[q], entry)
            elif entry > heaps[q][0]:
                heapq.heapreplace(heaps[q], entry)
    return [(int(ids[queries[q]]), -vec, score) for q, h in enumerate(heaps) for score, vec in h]


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    query_block: int = 1024,
    candidate_block: int = 8192,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """(query_id, rank, id, score): the ``k`` candidates of largest cosine of each query.

    Queries are the rows for which ``is_query`` (on the column ``id``) holds, candidates all rows but
    the query's own; ties go to the smaller id. The result is exact: the bounds never lose a neighbour.

    Vectors that are null, zero, or hold null or non-finite components take no part;
    vectors of different dimension are compared as if the shorter were filled up with zeros. Of rows with equal id the smallest vector stands, rows without id are left out; an
    empty table gives an empty one; other columns are not read.
    """
    rows = stored(vectors_of(vectors, id_col, vector_col).where(usable(F.col("v"))))
    sizes = rows.select(F.count("*").alias("n"), F.count_if(is_query).alias("q")).first()
    across, down = max(1, -(-sizes["n"] // candidate_block)), max(1, -(-sizes["q"] // query_block))
    block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    queries = rows.where(is_query).select("id", "v", F.lit(True).alias("query"), block(down).alias("qb")).withColumn("cb", every(across))
    others = rows.select("id", "v", F.lit(False).alias("query"), block(across).alias("cb")).withColumn("qb", every(down))
    tiles = queries.unionByName(others).repartition("qb", "cb").sortWithinPartitions("qb", "cb", "id")

    def run(batches: Arrow) -> Arrow:
        for table, begins in whole_groups(batches, ["qb", "cb"], 1):
            for start, end in zip(begins[:-1].tolist(), begins[1:].tolist()):
                tile = table.slice(start, end - start)
                query = np.asarray(tile.column("query").to_pylist(), bool)
                found = _tile(tile.column("id").to_numpy(), matrix(tile.column("v")), np.flatnonzero(query), np.flatnonzero(~query), k, 2048) if query.any() else []
                columns = list(zip(*found)) or [()] * 3
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())],
                    ["query_id", "id", "score"],
                )

    found = tiles.select("qb", "cb", "id", "query", "v").mapInArrow(run, "query_id long, id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")
