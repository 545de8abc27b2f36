import random

import pytest
from helpers import prose, sha
from pyspark.sql import functions as F

from catalogloom.llm import merkle, order, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, tree int, pos string, at int, level string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "a", 1, "b", 2, "c") for r in rows], SCHEMA)


def leaf(row, text):
    doc_id, _, lang, source, n_chars = row
    shown = [None if v is None else str(v) for v in (doc_id, source, lang, n_chars, text)]
    return sha("".join("-" if v is None else f"{len(v.encode())}:{v}" for v in shown))


def climb(nodes, siblings):
    """Each node's path of (run, place) to the top of ``nodes``, and the top."""
    paths = [[] for _ in nodes]
    level, under = nodes, [[k] for k in range(len(nodes))]
    while len(level) > 1:
        above, members = [], []
        for at in range(0, len(level), siblings):
            run = level[at : at + siblings]
            for k in range(len(run)):
                for node in under[at + k]:
                    paths[node].append((run, k))
            above.append(sha("".join(run)))
            members.append([n for u in under[at : at + siblings] for n in u])
        level, under = above, members
    return paths, level[0]


def brute(rows, tampered, arity=3):
    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append(r)
    order_ = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    found, subroots = [], []
    for s in order_:
        own = sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, bytes.fromhex(leaf(r, r[1]))))
        paths, top = climb([leaf(r, r[1]) for r in own], arity)
        subroots.append(top)
        found.append(list(zip(own, paths)))
    upper, root = climb(subroots, arity)
    out = []
    for members, subroot, rest in zip(found, subroots, upper):
        for r, path in members:
            h, siblings = leaf(r, tampered(r)), ""
            for run, k in path + rest:
                h = sha("".join([*run[:k], h, *run[k + 1 :]]))
                siblings += "".join(run[:k] + run[k + 1 :])
            out.append((r[0], leaf(r, r[1]), subroot, root, sha(siblings), h, h == root))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(3)
    rows = [(i, prose(i, 12) + "\nmore", "en", "hot", 40) for i in range(800)]
    rows += [(i, prose(i, 5) + "\n" * (i % 2), rng.choice(["de", None]), f"s{i % 11}", None) for i in range(800, 900)]
    rows += [(900, None, None, None, None), (901, "", "en", "", 0), (902, "\n\n", "en", "é", 2), (903, "x" * 300_000 + "\n", "en", "Z", 1)]
    return rows + [(None, "no id\n", "en", "hot", 3), (905, "same", "en", "hot", 4), (905, "same", "en", "hot", 4), (905, "other", "en", "hot", 4)]


def run(spark, rows, **kwargs):
    docs = table(spark, rows)
    changed = merkle.leaf_digest([F.col(c) for c in ("doc_id", "source", "lang", "n_chars")] + [F.replace("text", F.lit("\n"), F.lit(""))])
    found = merkle.folded(merkle.manifest(docs, claimed=F.when(F.col("doc_id") % 2 == 0, changed), **kwargs))
    names = ["leaf", "subroot", "root", "proof_sha256", "folded_root"]
    return sorted(((r["doc_id"], *(r[c].hex() for c in names), r["verified"]) for r in found.collect()), key=str)


def tampered(row):
    return row[1].replace("\n", "") if row[1] is not None and row[0] is not None and row[0] % 2 == 0 else row[1]


@pytest.mark.parametrize("shape", [{}, {"height": 2}, {"arity": 5, "height": 1}])
def test_equals_brute_force(spark, shape):
    want = brute(corpus(), tampered, shape.get("arity", 3))
    assert run(spark, corpus(), **shape) == want
    assert {w[-1] for w in want} == {True, False}


def test_one_group_one_row_and_none(spark):
    one = [r for r in corpus() if r[3] == "hot"][:10]
    assert run(spark, one) == brute(one, tampered)
    assert run(spark, one[:1]) == brute(one[:1], tampered)
    lone = [(k, "t", "en", f"g{k}", 1) for k in range(10)]
    assert run(spark, lone) == brute(lone, tampered)
    assert run(spark, []) == []


def test_query_names_the_rows_that_were_changed(spark):
    found = queries.op13_merkle_manifest(spark, "/root/testdata/sf0.001")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    touched = docs.where((F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0) & F.contains("text", F.lit("\n")))
    wrong = found.where("not verified")
    assert {r[0] for r in wrong.select("doc_id").collect()} == {r[0] for r in touched.select("doc_id").collect()}
    assert found.count() == docs.count()


def test_positions(spark):
    rows = spark.range(5000).select((F.col("id") % 7).alias("k"), "id").repartition(13)
    found = order.positions(rows, [F.asc("k"), F.desc("id")]).collect()
    want = sorted(((r["k"], r["id"]) for r in found), key=lambda r: (r[0], -r[1]))
    assert [(r["k"], r["id"]) for r in sorted(found, key=lambda r: r["at"])] == want
    assert sorted(r["at"] for r in found) == list(range(5000))
