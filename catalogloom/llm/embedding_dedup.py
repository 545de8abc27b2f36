"""Near copies among embeddings: p-stable hashing of unit vectors, then exact cosines.

Equal vectors form a class first. A class representative is hashed into ``tables`` buckets, each by
``functions`` random projections cut into steps of ``width``; members of a bucket are compared in
double precision. A pair is looked at in the first table that holds it, so links are counted once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .blocks import Forest, dealt, pairs, together, whole_groups
from .common import Arrow, stored, temporary
from .graph import components


def usable(c: Column) -> Column:
    """The vector takes part: not null, finite throughout, not zero."""
    finite = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(c, lambda x: x != 0), F.lit(False))


def vectors_of(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): one row per id; the smallest vector of an id that has several; rows without id go."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where("id is not null")
    return rows.groupBy("id").agg(F.min("v").alias("v"))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors as rows of doubles, shorter ones filled up with zeros.

    Each is scaled by a power of two to a largest component near 1: no sum of squares overflows, and
    cosines stay what they are to the last bit.
    """
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(sizes) and (sizes == sizes[0]).all():
        out = flat.reshape(len(sizes), -1).copy()
    else:
        out = np.zeros((len(sizes), int(sizes.max(initial=0))))
        out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return np.ldexp(out, -np.frexp(np.abs(out).max(axis=1, keepdims=True))[1]) if len(out) else out


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True)) if len(rows) else rows


def _hashed(representatives: DataFrame, functions: int, tables: int, width: float, seed: int) -> DataFrame:
    """Adds ``buckets``: one 32-bit bucket number per table, as bytes."""

    def run(batches: Arrow) -> Arrow:
        planes: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        mix = np.random.default_rng(seed).integers(1, 1 << 62, size=(tables, functions), dtype=np.int64) | 1
        for batch in batches:
            sizes = np.diff(batch.column("v").offsets.to_numpy())
            rows = unit(matrix(batch.column("v")))
            out = np.empty((len(rows), tables), np.uint32)
            for d in np.unique(sizes).tolist():  # vectors of another dimension are hashed by planes of their own
                if d not in planes:
                    random = np.random.default_rng([seed, d])
                    planes[d] = random.standard_normal((d, tables * functions)), random.uniform(0, width, tables * functions)
                a, b = planes[d]
                at = np.flatnonzero(sizes == d)
                steps = np.floor((rows[at, :d] @ a + b) / width).astype(np.int64).reshape(len(at), tables, functions)
                mixed = (steps * mix).sum(axis=2) + d  # wraps around
                out[at] = ((mixed * np.int64(-7046029254386353131)) >> 32).astype(np.uint32)
            codes = pa.array([r.tobytes() for r in out], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, codes], [*batch.schema.names, "buckets"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in representatives.schema)
    return representatives.mapInArrow(run, f"{schema}, buckets binary")


def _keyed(hashed: DataFrame, tables: int) -> DataFrame:
    """A row per table: key = table number above its 32-bit bucket number."""
    part = F.conv(F.hex(F.substring("buckets", F.col("table") * 4 + 1, F.lit(4))), 16, 10).cast("long")
    exploded = hashed.withColumn("table", F.explode(F.sequence(F.lit(0), F.lit(tables - 1))))
    return exploded.withColumn("key", F.shiftleft(F.col("table").cast("long"), 32) + part).drop("table")


def first_meeting(codes: np.ndarray, table: np.ndarray, i: np.ndarray, j: np.ndarray, step: int = 8) -> np.ndarray:
    """Which pairs share no bucket in a table before ``table[i]``."""
    alive = np.arange(len(i))
    for c in range(0, codes.shape[1], step):
        now = alive[table[i[alive]] > c]
        if not len(now):
            break
        same = codes[i[now], c : c + step] == codes[j[now], c : c + step]
        same &= np.arange(c, c + same.shape[1]) < table[i[now]][:, None]
        gone = now[same.any(axis=1)]
        alive = np.setdiff1d(alive, gone, assume_unique=True)
    return alive


def _compared(groups: DataFrame, threshold: float) -> DataFrame:
    """(id, leader, links): links of a group's rows, and a smaller row that each is joined to."""

    def run(batches: Arrow) -> Arrow:
        for table, begins in whole_groups(batches, ["key", "lo", "hi"]):
            ids, copies = table.column("id").to_numpy(), table.column("copies").to_numpy()
            lo, hi, side = (table.column(c).to_numpy() for c in ("lo", "hi", "side"))
            sizes = np.diff(table.column("v").combine_chunks().offsets.to_numpy())
            rows = matrix(table.column("v"))
            norms = np.sqrt((rows * rows).sum(axis=1))
            codes = np.frombuffer(b"".join(table.column("buckets").to_pylist()), ">u4").reshape(len(ids), -1)
            of = table.column("key").to_numpy() >> 32
            links, forest = np.zeros(len(ids), np.int64), Forest(len(ids))
            for i, j in pairs(begins, lo, hi, side, 1 << 17):
                keep = first_meeting(codes, of, i, j)
                keep = keep[sizes[i[keep]] == sizes[j[keep]]]
                i, j = i[keep], j[keep]
                near = np.einsum("ij,ij->i", rows[i], rows[j]) / (norms[i] * norms[j]) >= threshold
                i, j = i[near], j[near]
                np.add.at(links, i, copies[j])
                np.add.at(links, j, copies[i])
                forest.join(i, j)
            at = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[at]), pa.array(ids[forest.label[at]]), pa.array(links[at])], ["id", "leader", "links"]
            )

    columns = groups.select("key", "lo", "hi", "side", "id", "copies", "v", "buckets")
    return columns.mapInArrow(run, "id long, leader long, links long")


def link_embeddings(
    embeddings: DataFrame,
    threshold: float = 0.9,
    functions: int = 16,
    tables: int = 64,
    width: float = 2.0,
    seed: int = 11,
    block: int = 512,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """(id, n_links, component_id, kept) of every vector.

    With the defaults a pair at cosine 0.9 meets in some table with probability 0.94, at 0.95 with
    0.9996; no pair below ``threshold`` links. Vectors of different dimension never link.

    Vectors that are null, zero, or hold null or non-finite components have no links and are their own
    component. Of rows with equal id the smallest vector stands, rows without id are left out; an empty
    table gives an empty one; other columns are not read. Equal vectors are one class however many
    there are, and a bucket of any size is dealt out in pairs of blocks of ``block`` rows.
    """
    with temporary():
        rows = stored(vectors_of(embeddings, id_col, vector_col))
        classes = rows.where(usable(F.col("v"))).groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("copies"))
        classes = stored(_hashed(classes.select("id", "copies", "v"), functions, tables, width, seed))
        groups = dealt(_keyed(classes, tables), classes, F.lit(1), block)
        found = stored(_compared(together(groups), threshold))
        edges = found.select(F.col("leader").alias("a"), F.col("id").alias("b"))
        joined = classes.select("id", "copies", "v").join(found.groupBy("id").agg(F.sum("links").alias("links")), "id", "left")
        joined = joined.join(components(edges).withColumnRenamed("node", "id"), "id", "left").select(
            "v",
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("component", "id").alias("component_id"),
        )
        result = rows.withColumn("use", F.when(usable(F.col("v")), F.col("v"))).join(joined.withColumnRenamed("v", "use"), "use", "left")
        component = F.coalesce("component_id", "id")
        result = result.select(
            F.col("id").alias(id_col),
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            component.alias("component_id"),
            (F.col("id") == component).alias("kept"),
        )
        return stored(result, outlive=True)
