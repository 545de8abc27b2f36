"""Whitening of embeddings by an incremental eigendecomposition.

Each part of the distinct vectors takes them in one by one: a centred rank-one update of its spectrum per
vector, by a secular equation with deflation. The parts' spectra are combined in a tree, again by rank-one
updates, an eigenpair at a time. The combined basis is refined by a Rayleigh-Ritz step over all vectors:
what is left of the covariance in that basis is summed up in the tasks and diagonalised.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .blocks import whole_groups
from .common import Arrow, stored, temporary
from .eigen import Scatter

#: Scaled entries stay below this, so that they are exact as doubles.
MOST = float(1 << 52)


@dataclass(frozen=True)
class Whitening:
    """Components of the distinct vectors; its size depends on their dimension only."""

    n: int
    sums: np.ndarray  # of whole numbers
    values: np.ndarray  # variances, falling
    vectors: np.ndarray  # a component per column
    trace: float
    identity_error: float


def usable(c: Column) -> Column:
    """Not null, without null or non-finite entries."""
    return F.coalesce(F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def whole(c: Column, scale: int, shift: int) -> Column:
    """Entries as whole numbers: floor(scale * entry) + shift, the product held within +-2^52."""
    bounded = lambda x: F.greatest(F.lit(-MOST), F.least(F.lit(MOST), x.cast("double") * float(scale)))
    return F.transform(c, lambda x: F.floor(bounded(x)).cast("long") + F.lit(shift).cast("long"))


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str, scale: int, shift: int) -> DataFrame:
    """(id, x) of the usable rows, stored; shorter vectors are filled up with zeros."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where(usable(F.col("v")))
    rows = stored(rows.select("id", whole(F.col("v"), scale, shift).alias("x")), outlive=True)
    size = rows.agg(F.max(F.size("x"))).first()[0] or 0
    missing = F.greatest(F.lit(0), F.lit(size) - F.size("x"))
    return rows.select("id", F.concat("x", F.array_repeat(F.lit(shift).cast("long"), missing)).alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _merged(parts: DataFrame, merge: Callable[[list[bytes]], bytes], each: int = 16) -> bytes:
    """One state from all rows (part, state): ``each`` at a time, in written rounds."""

    def run(batches: Arrow) -> Arrow:
        for table, begins in whole_groups(batches, ["group"], 1):
            states, group = table.column("state").to_pylist(), table.column("group").to_pylist()
            for start, end in zip(begins[:-1].tolist(), begins[1:].tolist()):
                state = merge(states[start:end])
                yield pa.RecordBatch.from_arrays([pa.array([group[start]], pa.int64()), pa.array([state], pa.binary())], ["part", "state"])

    parts = stored(parts)
    # Parts without rows have left none, so the numbers have gaps; they only get fewer.
    while (n := parts.agg(F.count("*"), F.max("part")).first())[0] > 1:
        grouped = parts.withColumn("group", F.expr(f"part div {each}") if n[1] else F.lit(0).cast("long"))
        laid = grouped.repartition("group").sortWithinPartitions("group", "part")
        parts = stored(laid.select("group", "state").mapInArrow(run, "part long, state binary"))
    return bytes(parts.first()["state"])


def _part(of_batches: Callable[[list[np.ndarray]], bytes]):
    """A function for mapInArrow: one (part, state) row from all vectors of a task."""

    def run(batches: Arrow) -> Arrow:
        from pyspark import TaskContext

        state = of_batches(_matrix(b.column(0)) for b in batches if b.num_rows)
        if state is not None:
            part = pa.array([TaskContext.get().partitionId()], pa.int64())
            yield pa.RecordBatch.from_arrays([part, pa.array([state], pa.binary())], ["part", "state"])

    return run


def _added(states: list[bytes]) -> bytes:
    return np.sum([np.frombuffer(s, "<f8") for s in states], axis=0).astype("<f8").tobytes()


def fit(vectors: DataFrame, components: int, part_rows: int = 4096, tolerance: float = 1e-9) -> Whitening | None:
    """The whitening of the distinct vectors of (x); None if there are none.

    Fewer than ``components`` come back if the covariance has no more: directions whose variance is below
    rounding have none. The basis is refined until the whitened covariance is the identity to ``tolerance``
    (once is enough unless the spectrum reaches down to rounding).

    A vector costs a rank-one update, d^3 operations; a task holds a d x d basis, as does the driver.
    """
    distinct = stored(vectors.select("x").distinct())
    n = distinct.count()
    if not n:
        return None

    def sums(batches: Arrow) -> Arrow:
        total: np.ndarray | int = 0
        for batch in batches:
            if batch.num_rows:
                total = total + _matrix(batch.column(0)).sum(axis=0)
        if not isinstance(total, int):
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int64()), pa.array(total, pa.int64())], ["dim", "part"])

    by_dim = distinct.mapInArrow(sums, "dim long, part long").groupBy("dim").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("total"))
    found = {r["dim"]: int(r["total"]) for r in by_dim.collect()}  # one row per dimension
    totals = np.array([found[k] for k in range(len(found))], object)
    size = len(totals)
    if not size:
        return None
    parts = -(-n // part_rows)
    dealt = stored(distinct.repartition(parts, "x"))
    base, rest = _centre(n, totals)

    def spectrum(matrices):
        state = None
        for rows in matrices:
            state = state or Scatter(size)
            for row in (rows - base).astype(float):
                state.add(row)
        return state and state.to_bytes()

    def combined(states: list[bytes]) -> bytes:
        first = Scatter.from_bytes(states[0])
        for other in states[1:]:
            first.merge(Scatter.from_bytes(other))
        return first.to_bytes()

    basis = Scatter.from_bytes(_merged(dealt.mapInArrow(_part(spectrum), "part long, state binary"), combined)).vectors[:, ::-1]
    for _ in range(4):
        basis = np.linalg.qr(basis)[0]
        left = _covariance(dealt, base, rest, basis, n)
        values, turn = np.linalg.eigh((left + left.T) / 2)
        values, basis = values[::-1], basis @ turn[:, ::-1]
        real = int((values > size * np.finfo(float).eps * max(values[0], 0)).sum())
        keep = min(components, real)
        scaled = basis[:, :keep] / np.sqrt(values[:keep])
        error = float(np.abs(_covariance(dealt, base, rest, scaled, n) - np.eye(keep)).max(initial=0)) if keep else 0.0
        if error <= tolerance:
            break
    return Whitening(n, totals, values[:keep], basis[:, :keep], float(np.trace(left)), error)


def _centre(n: int, totals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The mean as whole numbers and what is left of it, below one."""
    base = np.array([t // n for t in totals], np.int64)
    return base, np.array([(t - n * int(b)) / n for t, b in zip(totals, base)], float)


def _covariance(vectors: DataFrame, base: np.ndarray, rest: np.ndarray, basis: np.ndarray, n: int) -> np.ndarray:
    """The covariance (divisor n) of all vectors in the coordinates of ``basis``."""

    def moments(matrices):
        total = None
        for rows in matrices:
            at = ((rows - base) - rest) @ basis
            total = at.T @ at if total is None else total + at.T @ at
        return None if total is None else total.astype("<f8").tobytes()

    flat = np.frombuffer(_merged(vectors.mapInArrow(_part(moments), "part long, state binary"), _added), "<f8")
    return flat.reshape(basis.shape[1], basis.shape[1]) / n


def _deviations(rows: np.ndarray, n: int, totals: np.ndarray, base: np.ndarray) -> list[int | None]:
    """The exact sum of (n x - S)^2 of each row; None where it is no 64-bit number."""
    rest = [int(t) - n * int(b) for t, b in zip(totals, base)]
    away = rows - base
    if rows.size and (n * float(np.abs(away).max()) + n) ** 2 * rows.shape[1] < 2**62:
        return ((n * away - np.array(rest, np.int64)) ** 2).sum(axis=1).tolist()
    exact = [sum((n * int(a) - r) ** 2 for a, r in zip(row, rest)) for row in away.tolist()]
    return [v if v < 1 << 63 else None for v in exact]


def whiten(
    vectors: DataFrame,
    components: int = 16,
    scale: int = 64,
    shift: int = 1_000_000,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) per usable row and component.

    Vectors become whole numbers x = floor(scale * entry) + shift; the fit takes each distinct x once.
    ``whitened`` is x less the mean, projected on the unit component, over the root of its variance;
    ``deviation`` the exact sum of (n x - S)^2, null where that is no 64-bit number.

    Rows whose vector is null or holds null or non-finite entries are left out. Shorter vectors are filled
    up with zeros; products beyond 2^52 count as 2^52. Repeated rows and ids give repeated rows, a null id
    is passed on. Directions without variance are no components: one distinct vector, like an empty
    table, gives an empty result. Other columns are not read.
    """
    with temporary():
        rows = whole_vectors(vectors, id_col, vector_col, scale, shift)
        model = fit(rows, components)
    schema = "component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None or not len(model.values):
        return vectors.sparkSession.createDataFrame([], f"`{id_col}` long, {schema}")
    base, rest = _centre(model.n, model.sums)
    basis, keep = model.vectors / np.sqrt(model.values), len(model.values)
    n, totals, explained, error = model.n, model.sums, model.values / model.trace, model.identity_error

    def run(batches: Arrow) -> Arrow:
        for batch in batches:
            x = _matrix(batch.column("x"))
            if not len(x):
                continue
            projected = ((x - base) - rest) @ basis
            count = len(x)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").take(pa.array(np.repeat(np.arange(count), keep))),
                    pa.array(np.tile(np.arange(1, keep + 1, dtype=np.int32), count)),
                    pa.array(np.full(count * keep, n), pa.int64()),
                    pa.array(_deviations(x, n, totals, base), pa.int64()).take(pa.array(np.repeat(np.arange(count), keep))),
                    pa.array(projected.ravel()),
                    pa.array(np.tile(explained, count)),
                    pa.array(np.full(count * keep, error)),
                ],
                ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(run, f"id long, {schema}").withColumnRenamed("id", id_col)
