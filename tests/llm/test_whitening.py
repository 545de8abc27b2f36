import math

import numpy as np

from catalogloom.llm import eigen, whitening

SCHEMA = "vec_id long, embedding array<double>, x string, part int, id string, component string, n string"


def table(spark, rows):
    return spark.createDataFrame([(i, e, "a", 1, "b", "c", "d") for i, e in rows], SCHEMA)


def brute(rows, most=16):
    """Everything from the dense covariance: (n, deviations by row, components, explained)."""
    good = [(i, e) for i, e in rows if e is not None and all(v is not None and math.isfinite(v) for v in e)]
    size = max(len(e) for _, e in good)
    x = [[math.floor(64 * v) + 1000000 for v in e] + [1000000] * (size - len(e)) for _, e in good]
    fit = sorted(set(map(tuple, x)))
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    away = np.array([[n * v - s for v, s in zip(f, sums)] for f in fit], float) / n
    values, vectors = np.linalg.eigh(away.T @ away / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    keep = min(most, int((values > 1e-12 * values[0]).sum()))
    out = []
    for (i, _), row in zip(good, x):
        deviation = sum((n * v - s) ** 2 for v, s in zip(row, sums))
        centred = np.array([n * v - s for v, s in zip(row, sums)], float) / n
        out.append((i, deviation, centred @ vectors[:, :keep] / np.sqrt(values[:keep])))
    return n, out, values[:keep] / values.sum()


def check(spark, rows, most=16):
    n, want, explained = brute(rows, most)
    got = {}
    for r in whitening.whiten(table(spark, rows)).collect():
        got.setdefault((r["vec_id"], r["deviation"]), {}).setdefault(r["component"], []).append(r)
    assert sum(len(rs) for c in got.values() for rs in c.values()) == len(want) * len(explained)
    sign = {}
    for i, deviation, whitened in want:
        own = got[i, deviation]
        assert sorted(own) == list(range(1, len(explained) + 1))
        for k, value in enumerate(whitened, 1):
            for r in own[k]:
                assert r["n"] == n and r["identity_error"] <= 1e-6
                assert abs(r["explained"] - explained[k - 1]) <= 1e-9 * explained[k - 1]
                if abs(value) > 1e-6:
                    assert sign.setdefault(k, np.sign(value * r["whitened"])) == np.sign(value * r["whitened"])
                assert abs(abs(r["whitened"]) - abs(value)) < 1e-7


def vectors(seed, n=300, d=20):
    rng = np.random.default_rng(seed)
    return [(i, e.tolist()) for i, e in enumerate(rng.standard_normal((n, d)) * np.linspace(0.3, 2, d))]


def test_equals_dense_covariance(spark, monkeypatch):
    rows = vectors(1)
    rows += [(i + 1000, e) for i, e in rows[:80]] + [rows[5], (None, rows[6][1])]  # repeated vectors, rows, a null id
    rows += [(2000, None), (2001, [math.nan] * 20), (2002, [math.inf] + [0.0] * 19), (2003, [None] * 20), (2004, [0.0] * 20)]
    check(spark, rows)
    monkeypatch.setattr(whitening.fit, "__defaults__", (16, 1e-9))  # many parts, several merge rounds
    check(spark, rows)


def test_short_vectors_and_few_components(spark):
    check(spark, [(i, e[: 3 + i % 2]) for i, e in enumerate(e for _, e in vectors(2, 40, 4))])
    line = [(i, [float(i), 2.0 * i, 5.0]) for i in range(30)]  # one direction only
    check(spark, line)


def test_large_entries(spark):
    rows = [(i, [e[0] * 1e9, e[1] * 1e9]) for i, e in vectors(3, 50, 2)]
    found = whitening.whiten(table(spark, rows)).collect()
    n, want, _ = brute(rows)
    exact = {i: d for i, d, _ in want}
    assert all(r["deviation"] == (exact[r["vec_id"]] if exact[r["vec_id"]] < 2**63 else None) for r in found)
    assert len(found) == 100 and any(r["deviation"] is None for r in found)
    assert len(whitening.whiten(table(spark, [(1, [1e308]), (2, [-1e308]), (3, [0.0])])).collect()) == 3


def test_nothing_to_fit(spark):
    assert whitening.whiten(table(spark, [])).collect() == []
    assert whitening.whiten(table(spark, [(1, None)])).collect() == []
    assert whitening.whiten(table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect() == []
    assert whitening.whiten(table(spark, [(1, []), (2, [])])).collect() == []


def test_rank_one_updates_keep_the_spectrum():
    rng = np.random.default_rng(4)
    for rows in (rng.standard_normal((200, 12)), np.repeat(rng.integers(0, 3, (50, 6)), 3, axis=0).astype(float), np.hstack([rng.standard_normal((90, 3))] * 3)):
        both = [eigen.Scatter(rows.shape[1]) for _ in range(2)]
        for k, row in enumerate(rows):
            both[k % 2].add(row)
        both[0].merge(eigen.Scatter.from_bytes(both[1].to_bytes()))
        away = rows - rows.mean(axis=0)
        found = both[0].vectors @ np.diag(both[0].values) @ both[0].vectors.T
        assert np.abs(found - away.T @ away).max() < 1e-11 * both[0].values.max()
        assert np.abs(both[0].vectors.T @ both[0].vectors - np.eye(rows.shape[1])).max() < 1e-12
        assert both[0].n == len(rows) and np.allclose(both[0].mean, rows.mean(axis=0))
