"""Comparing the members of buckets: large buckets are dealt out as pairs of blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import Arrow, stored


def dealt(members: DataFrame, payload: DataFrame, weight: Column, block: float) -> DataFrame:
    """(key, side, lo, hi, id, ...): every two members (key, id) of a key meet in one group (key, lo, hi).

    A key whose weights sum to more than ``block`` is split by hash of ``id`` into blocks of about
    that weight, and each pair of blocks is a group of its own, so no task holds more than two blocks.
    Keys of one row are left out before the columns of ``payload``, one row per id, are joined.
    """
    light = members.select("key", "id", weight.alias("w"))
    sizes = light.groupBy("key").agg(F.count("*").alias("n"), F.sum("w").alias("w")).where("n > 1")
    # Stored, so that the join deals out both sides itself and can split a hot key.
    sizes = stored(sizes.select("key", F.greatest(F.lit(1), F.ceil(F.col("w") / F.lit(block))).cast("int").alias("parts")))
    split = light.drop("w").join(sizes.hint("merge"), "key")
    split = split.withColumn("side", F.pmod(F.xxhash64("id", F.lit(7)), F.col("parts")).cast("int"))
    split = split.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    light = split.select("key", "id", "side", F.least("side", "other").alias("lo"), F.greatest("side", "other").alias("hi"))
    return light.join(payload, "id")


def together(groups: DataFrame) -> DataFrame:
    """``groups`` laid out so that the rows of each (key, lo, hi) follow one another."""
    return groups.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "id")


def whole_groups(batches: Arrow, keys: list[str], least_rows: int = 4096) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of complete groups, and where in them each group begins (with the end added)."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < least_rows:
            continue
        table = pa.Table.from_batches(held)
        begins = _begins(table, keys)
        last = int(begins[-2])
        if last:
            yield table.slice(0, last), begins[:-1]
            rest = table.slice(last).combine_chunks()
            held, rows = rest.to_batches(), rest.num_rows
        # a group that is not complete yet may be long: look again after as many rows
        least_rows = max(4096, 2 * rows)
    if held:
        table = pa.Table.from_batches(held)
        yield table, _begins(table, keys)


def _begins(table: pa.Table, keys: list[str]) -> np.ndarray:
    n = table.num_rows
    change = np.zeros(n, bool)
    change[0] = True
    for key in keys:
        v = table.column(key).to_numpy()
        change[1:] |= v[1:] != v[:-1]
    return np.concatenate([np.flatnonzero(change), [n]])


def pairs(begins: np.ndarray, lo: np.ndarray, hi: np.ndarray, side: np.ndarray, most: int = 1 << 19) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers (i, j) of the pairs of each group, some groups at a time, long ones in strips."""
    left: list[np.ndarray] = []
    right: list[np.ndarray] = []
    size = 0
    for start, end in zip(begins[:-1].tolist(), begins[1:].tolist()):
        if lo[start] == hi[start]:
            if end - start == 2:
                a, b = np.array([start]), np.array([start + 1])
                left.append(a), right.append(b)
                size += 1
            else:
                for i in range(start, end - 1):
                    left.append(np.full(end - 1 - i, i))
                    right.append(np.arange(i + 1, end))
                    size += end - 1 - i
                    if size >= most:
                        yield np.concatenate(left), np.concatenate(right)
                        left, right, size = [], [], 0
        else:
            rows = np.arange(start, end)
            mine, theirs = rows[side[start:end] == lo[start]], rows[side[start:end] == hi[start]]
            for i in mine.tolist():
                left.append(np.full(len(theirs), i))
                right.append(theirs)
                size += len(theirs)
                if size >= most:
                    yield np.concatenate(left), np.concatenate(right)
                    left, right, size = [], [], 0
        if size >= most:
            yield np.concatenate(left), np.concatenate(right)
            left, right, size = [], [], 0
    if size:
        yield np.concatenate(left), np.concatenate(right)


class Forest:
    """Joins of rows 0..n-1, kept as the smallest row of each joined set."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        label = self.label
        while len(i):
            a, b = label[i], label[j]
            low, high = np.minimum(a, b), np.maximum(a, b)
            apart = low < high
            if not apart.any():
                return
            i, j = i[apart], j[apart]
            np.minimum.at(label, high[apart], low[apart])
            while True:  # follow labels to their ends
                ahead = label[label]
                if (ahead == label).all():
                    break
                label[:] = ahead
