import random

import numpy as np
import pytest
from helpers import documents, prose, reachable

from catalogloom.llm import jaccard_join


def grams(text, words=5):
    w = (text or "").lower().split()
    return frozenset(tuple(w[k : k + words]) for k in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)] if w else [])


def near(a, b, threshold=0.8):
    return a == b or (bool(a and b) and len(a & b) >= threshold * len(a | b))


def check(spark, rows, **more):
    found = {r["doc_id"]: r for r in jaccard_join.join_documents(documents(spark, rows), **more).collect()}
    sets = {i: grams(t) for i, t in rows}
    edges = [(a, b) for a in sets for b in sets if a < b and near(sets[a], sets[b])]
    label = reachable(sets, edges)
    assert {i: r["n_links"] for i, r in found.items()} == {i: sum(i in e for e in edges) for i in sets}
    assert {i: r["component_id"] for i, r in found.items()} == label
    assert {i: r["class_id"] for i, r in found.items()} == {i: min(j for j in sets if sets[j] == sets[i]) for i in sets}
    assert all(r["kept"] == (i == label[i]) for i, r in found.items())
    return edges


def corpus(seed):
    rng, rows = random.Random(seed), []
    for i in range(120):
        words = prose(seed * 999 + i, rng.choice([3, 5, 8, 60, 200])).split()
        if rows and rng.random() < 0.6:
            words = (rng.choice(rows)[1] or "x").split()
            for _ in range(rng.choice([0, 1, 2, 3, 5])):
                words[rng.randrange(len(words))] = "edit"
        rows.append((i, rng.choice([" ", "\n", "  "]).join(words)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    assert check(spark, corpus(seed))


def test_one_large_group_in_blocks(spark, monkeypatch):
    base = prose(1, 150).split()
    rows = []
    for i in range(150):
        words = list(base)
        words[i] = "other"
        rows.append((i, " ".join(words)))
    monkeypatch.setattr(jaccard_join, "dealt", lambda m, p, w, b, real=jaccard_join.dealt: real(m, p, w, b / 40))
    check(spark, rows)


def test_odd_rows(spark):
    check(spark, [(1, None), (2, ""), (3, " \n "), (4, "a b"), (5, "A  b"), (6, "a b c"), (7, prose(2, 30_000)), (8, prose(2, 30_000) + " end")])
    twice = jaccard_join.join_documents(documents(spark, [(1, "a b c d e f"), (1, "a b c d e f"), (None, "q")])).collect()
    assert sorted((r["n_links"] for r in twice)) == [0, 1, 1]
    assert jaccard_join.join_documents(documents(spark, [])).collect() == []


def test_rows_without_id_link_like_others(spark):
    base = prose(4, 60)
    rows = [(None, base), (None, base + " end"), (None, base), (None, "quite another text"), (5, prose(6, 60)), (None, prose(6, 60) + " end"), (7, prose(6, 60))]
    rows += [(8, prose(9, 60)), (8, prose(9, 60) + " end"), (8, prose(9, 60))]
    found = {}
    for r in jaccard_join.join_documents(documents(spark, rows)).collect():
        found.setdefault((r["doc_id"], r["n_links"], r["class_id"], r["component_id"]), []).append(r["kept"])
    assert {k: len(v) for k, v in found.items()} == {
        (None, 2, None, None): 3, (None, 0, None, None): 1, (5, 2, 5, 5): 1, (None, 2, None, 5): 1, (7, 2, 5, 5): 1, (8, 2, 8, 8): 3
    }
    assert found[5, 2, 5, 5] == [True] and found[7, 2, 5, 5] == [False] and found[None, 2, None, 5] == [False]
    # One text of each component is kept, with all rows that repeat it.
    assert sum(found[None, 2, None, None]) in (1, 2) and sum(found[8, 2, 8, 8]) in (1, 2)


def test_hashes_and_pruning():
    a, b = jaccard_join.shingle_sets(["x y z u v w", "x y z u v w"], 5)
    assert (a == b).all() and len(a) == 2
    assert jaccard_join.set_key(a) == jaccard_join.set_key(b)
    least = jaccard_join.least_matches(0.8, 128, 32, 1e-6)
    assert list(least) == sorted(least) and 0 < least[0] < 24
    bits = np.zeros((3, 128), np.uint8)
    bits[1, :10], bits[2] = 1, 1
    assert jaccard_join.likely(bits, np.array([0, 0]), np.array([1, 2]), least, 32).tolist() == [0]
