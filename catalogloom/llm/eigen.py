"""Eigendecompositions that take in one vector at a time (numpy, inside tasks)."""

from __future__ import annotations

import numpy as np

_EPS = np.finfo(float).eps


def _roots(d: np.ndarray, z2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The roots of ``1 + sum(z2 / (d - x)) = 0`` for ascending distinct ``d`` and positive ``z2``.

    Root i lies between d[i] and d[i + 1], the last one at most ``sum(z2)`` above d[-1]. Each is given as
    the number of the pole it is nearest to and its distance from there, so that differences to poles keep
    their digits. A rational step through the two neighbouring poles, halving where it leaves the bracket.
    """
    k = len(d)
    total = z2.sum()
    upper = np.append(d[1:], d[-1] + total)
    gap = upper - d
    middle = 1 + (z2 / (d - (d + gap / 2)[:, None])).sum(axis=1)
    origin = np.arange(k)
    right = middle < 0  # the function climbs from one pole to the next: the root lies beyond the middle
    right[-1] = False
    origin[right] += 1
    delta = d - d[origin][:, None]
    # Brackets relative to the origin; the middle is known to lie on one side.
    low = np.where(right, -gap / 2, 0.0)
    high = np.where(right, 0.0, gap / 2)
    if middle[-1] < 0:
        low[-1], high[-1] = gap[-1] / 2, gap[-1]
    x = (low + high) / 2
    rows = np.arange(k)
    last = k - 1
    below = rows[None, :] <= rows[:, None]
    one, two = rows.copy(), rows + 1  # the poles a step goes through
    one[-1], two[-1] = max(last - 1, 0), last
    two = np.minimum(two, last)
    below[-1] = rows < last
    for _ in range(100):
        apart = delta - x[:, None]
        terms = z2 / apart
        value = 1 + terms.sum(axis=1)
        slopes = terms / apart
        done = (np.abs(value) <= 8 * _EPS * k * (1 + np.abs(terms).sum(axis=1))) | (high - low <= 2 * _EPS * np.maximum(np.abs(low), np.abs(high)))
        if done.all():
            break
        low, high = np.where(value < 0, x, low), np.where(value > 0, x, high)
        left, both = np.where(below, slopes, 0).sum(axis=1), slopes.sum(axis=1)
        a1, a2 = apart[rows, one], apart[rows, two]
        c = value - a1 * left - a2 * (both - left)
        a = (a1 + a2) * value - a1 * a2 * both
        b = a1 * a2 * value
        with np.errstate(all="ignore"):
            root = np.sqrt(np.abs(a * a - 4 * b * c))
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
            end = a[-1] >= 0
            step[-1] = (a[-1] + root[-1]) / (2 * c[-1]) if end else 2 * b[-1] / (a[-1] - root[-1])
            moved = x + step
        inside = np.isfinite(moved) & (moved > low) & (moved < high)
        x = np.where(done, x, np.where(inside, moved, (low + high) / 2))
    return origin, x


def _merge_equal(d: np.ndarray, z: np.ndarray, vectors: np.ndarray, tolerance: float) -> None:
    """Turns the basis within runs of equal ``d`` so that one vector of each run takes all of ``z``."""
    close = np.diff(d) <= tolerance
    if not close.any():
        return
    edges = np.flatnonzero(np.diff(np.concatenate([[False], close, [False]]).astype(np.int8)))
    for start, end in zip(edges[::2].tolist(), (edges[1::2] + 1).tolist()):
        part = z[start:end]
        norm = float(np.sqrt(part @ part))
        if norm == 0:
            continue
        mirror = part.copy()
        mirror[-1] += norm if part[-1] >= 0 else -norm
        mirror /= np.sqrt(mirror @ mirror)
        vectors[:, start:end] -= 2 * np.outer(vectors[:, start:end] @ mirror, mirror)
        z[start : end - 1], z[end - 1] = 0, -norm if part[-1] >= 0 else norm
        d[start:end] = d[end - 1]


def rank_one(d: np.ndarray, vectors: np.ndarray, weight: float, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (ascending) and vectors of ``vectors diag(d) vectors' + weight x x'``, weight >= 0.

    Components of x that vanish, and all but one per run of equal eigenvalues, leave their eigenpairs as
    they are (deflation). The rest interlace: the secular equation gives the eigenvalues, and the vectors
    come from the z that has exactly these eigenvalues, which keeps them orthogonal.
    """
    z = np.sqrt(weight) * (x @ vectors)
    total = float(z @ z)
    scale = max(float(np.abs(d).max(initial=0)), total)
    if total == 0 or scale == 0:
        return d, vectors
    d, vectors = d.copy(), vectors.copy()
    _merge_equal(d, z, vectors, 8 * _EPS * scale)
    alive = np.flatnonzero(z * z > 8 * _EPS * scale * _EPS)
    if not len(alive):
        return d, vectors
    p, z2 = d[alive], z[alive] ** 2
    origin, x = _roots(p, z2)
    apart = (p[origin][:, None] - p) + x[:, None]  # root i minus pole j
    # The squares of the z that the computed roots belong to, as a product of ratios near one.
    k = len(p)
    poles = p[:, None] - p
    poles[np.arange(k), np.arange(k)] = 1
    ratios = apart.copy()
    ratios[:-1] = np.where(np.arange(k)[None, :] > np.arange(k - 1)[:, None], apart[:-1] / poles[:-1], apart[:-1] / poles[1:])
    exact = np.sqrt(np.abs(np.prod(ratios, axis=0)))
    found = np.copysign(exact, z[alive]) / -apart
    found /= np.sqrt((found * found).sum(axis=1, keepdims=True))
    d[alive] = p[origin] + x
    vectors[:, alive] = vectors[:, alive] @ found.T
    order = np.argsort(d, kind="stable")
    return d[order], vectors[:, order]


class Scatter:
    """Count, mean and eigendecomposition of the centred scatter of the vectors taken in so far."""

    def __init__(self, size: int):
        self.n, self.mean = 0, np.zeros(size)
        self.values, self.vectors = np.zeros(size), np.eye(size)

    def add(self, x: np.ndarray) -> None:
        away = x - self.mean
        self.n += 1
        self.mean = self.mean + away / self.n
        if self.n > 1:
            self.values, self.vectors = rank_one(self.values, self.vectors, (self.n - 1) / self.n, away)

    def merge(self, other: Scatter) -> None:
        """Takes in all vectors of ``other``: a rank-one update per eigenpair, one for the means."""
        if not other.n:
            return
        for value, vector in zip(other.values[::-1], other.vectors.T[::-1]):
            if value > 0:
                self.values, self.vectors = rank_one(self.values, self.vectors, float(value), vector)
        away, n = other.mean - self.mean, self.n + other.n
        if self.n:
            self.values, self.vectors = rank_one(self.values, self.vectors, self.n * other.n / n, away)
        self.mean = self.mean + away * (other.n / n)
        self.n = n

    def to_bytes(self) -> bytes:
        return np.concatenate([[self.n], self.mean, self.values, self.vectors.ravel()]).astype("<f8").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> Scatter:
        flat = np.frombuffer(data, "<f8")
        size = int(round((np.sqrt(4 + 4 * (len(flat) - 1)) - 2) / 2))
        out = cls(size)
        out.n, out.mean, out.values = int(flat[0]), flat[1 : 1 + size].copy(), flat[1 + size : 1 + 2 * size].copy()
        out.vectors = flat[1 + 2 * size :].reshape(size, size).copy()
        return out
