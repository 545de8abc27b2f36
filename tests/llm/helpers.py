"""Small tables and brute-force answers for the training-text tests."""

import hashlib
import random
from collections import defaultdict

WORDS = "ane berol cint dovar elun fams gorit hule inpa jorn kelt luno mers nilo opar".split()


def prose(seed: int, words: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(words))


def sha(text) -> str:
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def documents(spark, rows):
    """(doc_id, text) with columns whose names clash with those the operators make."""
    schema = "doc_id long, text string, id long, n_bytes string, score string, kept string, _gone int, size int, bin int"
    return spark.createDataFrame([(i, t, 7, "x", "y", "z", 1, 2, 3) for i, t in rows], schema)


def reachable(nodes, edges):
    """The smallest node that each can reach."""
    label = {n: n for n in nodes}
    while True:
        changed = False
        for a, b in edges:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
        if not changed:
            return label


def by_key(rows, key):
    out = defaultdict(list)
    for r in rows:
        out[r[key]].append(r)
    return out
