import math
import random

import numpy as np
from helpers import reachable
from pyspark.sql import functions as F

from catalogloom.llm import embedding_dedup, graph, nearest

SCHEMA = "vec_id long, embedding array<double>, label int, id string, v int, copies int, key int"


def table(spark, rows):
    return spark.createDataFrame([(i, e, 0, "a", 1, 2, 3) for i, e in rows], SCHEMA)


def usable(e):
    return e and all(x is not None and math.isfinite(x) for x in e) and any(e)


def cosine(a, b):
    n = max(len(a), len(b))
    a, b = [[x / max(map(abs, v)) for x in v] + [0] * (n - len(v)) for v in (a, b)]
    return sum(x * y for x, y in zip(a, b)) / (math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(y * y for y in b)))


def vectors(seed, n=150, d=24):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((n // 5, d))
    rows = [(i, (centres[rng.integers(len(centres))] + rng.normal(0, rng.choice([0, 0.05, 0.15]), d)).tolist()) for i in range(n)]
    odd = [None, [], [0.0] * d, [math.nan] * d, [math.inf, *[1.0] * (d - 1)], [None, *[1.0] * (d - 1)], [1e200] * d, [2e200] * d]
    return rows + [(1000 + k, e) for k, e in enumerate(odd)] + [rows[3], (2000, rows[3][1]), (2001, [2 * x for x in rows[3][1]])]


def test_links_equal_brute_force(spark):
    rows = vectors(1)
    found = {r["vec_id"]: r for r in embedding_dedup.link_embeddings(table(spark, rows), block=16, tables=96).collect()}
    good = {i: e for i, e in rows if usable(e)}
    edges = [(a, b) for a in good for b in good if a < b and cosine(good[a], good[b]) >= 0.9]
    label = reachable({i for i, _ in rows}, edges)
    links = {i: sum(i in e for e in edges) for i, _ in rows}
    assert {i: r["n_links"] for i, r in found.items()} == links
    assert {i: r["component_id"] for i, r in found.items()} == label
    assert all(r["kept"] == (i == r["component_id"]) for i, r in found.items())
    assert edges


def test_recall_on_links_just_above(spark):
    rng = np.random.default_rng(5)
    rows = []
    for k in range(400):
        a, b = rng.standard_normal((2, 64))
        a /= np.linalg.norm(a)
        b -= (a @ b) * a
        b /= np.linalg.norm(b)
        c = 0.9 + 0.02 * rng.random() + 1e-9
        rows += [(2 * k, a.tolist()), (2 * k + 1, (c * a + math.sqrt(1 - c * c) * b).tolist())]
    found = embedding_dedup.link_embeddings(table(spark, rows)).where("n_links > 0").count()
    assert found >= 0.9 * len(rows)


def test_nearest_is_exact(spark):
    rows = vectors(2) + [(3000, [1.0, 2.0])]
    found = nearest.nearest(table(spark, rows), F.col("id") % 10 == 0, query_block=4, candidate_block=32).collect()
    good = dict(sorted(((i, e) for i, e in rows if usable(e)), key=str))
    want = []
    for q in sorted(good):
        if q % 10 == 0:
            near = sorted((-cosine(good[q], good[c]), c) for c in good if c != q)[:5]
            want += [(q, k + 1, c) for k, (_, c) in enumerate(near)]
    got = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in found)
    scores = {(r["query_id"], r["rank"]): r["score"] for r in found}
    assert len(got) == len(want)
    for (q, k, c), (q2, k2, c2) in zip(got, want):
        assert (q, k) == (q2, k2)
        assert c == c2 or abs(cosine(good[q], good[c2]) - scores[q, k]) < 1e-12
    for q, k, c in got:
        assert abs(scores[q, k] - cosine(good[q], good[c])) < 1e-12


def test_nearest_ties_and_few_candidates(spark):
    same = [(i, [1.0, 2.0, 3.0]) for i in range(0, 12)]
    found = nearest.nearest(table(spark, same), F.col("id") == 10, candidate_block=4).collect()
    assert sorted((r["rank"], r["vec_id"]) for r in found) == [(1, 0), (2, 1), (3, 2), (4, 3), (5, 4)]
    assert len(nearest.nearest(table(spark, same[:3]), F.col("id") == 1).collect()) == 2


def test_empty_tables(spark):
    assert embedding_dedup.link_embeddings(table(spark, [])).collect() == []
    assert nearest.nearest(table(spark, []), F.col("id") % 2 == 0).collect() == []


def test_components(spark):
    rng = random.Random(3)
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 150)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)] + [(7, 7), (None, 3)]
    found = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    real = [e for e in edges if None not in e and e[0] != e[1]]
    assert found == reachable({n for e in real for n in e}, real)
