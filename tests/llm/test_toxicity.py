import math
import random
import re
import unicodedata
import zlib

from helpers import documents, prose
from pyspark.sql import functions as F

from catalogloom.llm import toxicity

BAD = ["idiot", "scumbag", "loser"]


def corpus():
    rows, labels = [], []
    for i in range(300):
        text, toxic = prose(i, 40) + " you", i % 3 == 0
        if toxic:
            text += f" you {BAD[i // 3 % 3]} " + prose(i + 999, 10)
        elif i % 13 == 0:
            text += " the loser bracket " + prose(i + 555, 5)
        rows.append((i, text))
        labels.append((i, int(toxic)))
    return rows, labels


def learned(spark):
    rows, labels = corpus()
    docs, marks = documents(spark, rows), spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int")
    return docs, toxicity.learn(docs, marks, toxicity.train_rows, least_ratio=3.0), dict(labels)


def test_held_out_rows_are_told_apart(spark):
    docs, lexicon, labels = learned(spark)
    assert {"idiot", "scumbag"} <= {t.rstrip("*") for t in lexicon.terms}
    assert "loser bracket" in lexicon.exceptions
    got = toxicity.scored(docs, lexicon).select("doc_id", "score", toxicity.predicted().alias("p"), toxicity.held_out(F.col("doc_id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r["h"]]
    assert held and all(r["p"] == labels[r["doc_id"]] for r in held)


def test_disguises_nulls_and_long_texts(spark):
    _, lexicon, _ = learned(spark)
    rows = [(1, "you 1d10t"), (2, "you ІDIОT!!"), (3, "you i\u200bdíot,"), (4, "you scumbags"), (5, "the loser bracket"), (6, None), (7, ""), (8, prose(3, 40_000)), (8, "ok"), (None, "idiot")]
    got = [(r["doc_id"], r["score"] >= 0.5, r["text"]) for r in toxicity.scored(documents(spark, rows), lexicon).collect()]
    assert sorted((i, p) for i, p, _ in got if i is not None) == [(1, True), (2, True), (3, True), (4, True), (5, False), (6, False), (7, False), (8, False), (8, False)]
    assert [p for i, p, _ in got if i is None] == [True]
    assert [t for i, _, t in got if i == 6] == [None]


def test_no_training_rows_and_empty_tables(spark):
    docs = documents(spark, [(1, "idiot"), (2, None)])
    lexicon = toxicity.learn(docs, spark.createDataFrame([], "doc_id long, toxic int"), toxicity.train_rows)
    assert all(0 <= r["score"] <= 1 for r in toxicity.scored(docs, lexicon).collect())
    assert toxicity.scored(documents(spark, []), lexicon).collect() == []


def test_matcher_counts_words_once():
    machine = toxicity.Matcher(toxicity.Lexicon({"bad": 2.0, "ba*": 1.0, "sad": 3.0}, ("not bad",)))
    assert machine.hits("bad bar not bad sad bad".split()) == [(0, "bad", 2.0), (1, "ba*", 1.0), (4, "sad", 3.0), (5, "bad", 2.0)]
    assert toxicity.Matcher(toxicity.Lexicon({}, ())).hits(["a"]) == []


def brute_score(text, lexicon):
    """Word by word: every term tried on it, unless it lies in an exception; the same curve on top."""
    words = re.findall(r"[^\W_]+", toxicity.fold(text or ""))
    bare = ["".join(c for c in unicodedata.normalize("NFKD", w) if not "\u0300" <= c <= "\u036f") for w in words]
    best = [0.0] * len(words)
    for form in (words, bare):
        hidden = set()
        for phrase in lexicon.exceptions:
            parts = phrase.split(" ")
            for k in range(len(form) - len(parts) + 1):
                if form[k : k + len(parts)] == parts:
                    hidden |= set(range(k, k + len(parts)))
        for k, word in enumerate(form):
            for term, weight in lexicon.terms.items():
                if k not in hidden and (word.startswith(term[:-1]) if term.endswith("*") else word == term):
                    best[k] = max(best[k], weight)
    value = (100 * sum(best) / (len(words) + 200)) ** (1 / 3)
    return 1 / (1 + math.exp(-max(-50, min(50, lexicon.level + lexicon.slope * value)))), sum(b > 0 for b in best)


def test_scores_equal_brute_force(spark):
    _, learned_, _ = learned(spark)
    rng = random.Random(2)
    terms = {t: w for t, w in list(learned_.terms.items())[:40]} | {"bad": 2.0, "ba*": 1.0, "nasty": 3.5, "cafe": 1.5}
    lexicon = toxicity.Lexicon(terms, (*learned_.exceptions[:20], "not bad", "trash can"), learned_.slope, learned_.level)
    atoms = ["bad", "B4D", "bar", "not", "nasty", "näsTy", "café", "trash", "can", "loser", "bracket", "1d10t", "scumbags", "x", "ІDIОT", "under_bad", *prose(1, 30).split()]
    rows = [(i, rng.choice([" ", ", ", "\n"]).join(rng.choice(atoms) for _ in range(rng.randrange(40)))) for i in range(300)] + [(900, None), (901, ""), (902, "bad " * 30_000)]
    found = toxicity.scored(documents(spark, rows), lexicon).collect()
    for r in found:
        score, hits = brute_score(dict(rows)[r["doc_id"]], lexicon)
        assert abs(r["score"] - score) < 1e-12 and r["n_hits"] == hits
    assert len(found) == len(rows) and len({r["n_hits"] for r in found}) > 5


def test_bounds_are_parameters(spark):
    rows, labels = corpus()
    docs, marks = documents(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    few = toxicity.learn(docs, marks, toxicity.train_rows, least_ratio=3.0, most_terms=2, exceptions=("kind idiot",))
    assert len(few.terms) == 2 and "kind idiot" in few.exceptions
    assert len(toxicity.learn(docs, marks, toxicity.train_rows, least_ratio=3.0).terms) > 2
