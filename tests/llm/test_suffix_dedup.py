import random

import numpy as np
import pyarrow as pa
import pytest
from helpers import documents, prose

from catalogloom.llm import suffix_dedup


def brute(rows, length, whole=False):
    """Result of every (id, text) row, by a table of all strings of ``length`` bytes."""
    texts = sorted({(-1 if i is None else i, (t or "").encode()) for i, t in rows})
    seen, out = set(), {}
    for key, data in texts:
        gone = [False] * len(data)
        for p in range(len(data) - length + 1):
            s = data[p : p + length]
            if s in seen:
                gone[p : p + length] = [True] * length
            seen.add(s)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out[key, data] = (len(data), sum(gone), spans, bytes(c for c, g in zip(data, gone) if not g))
    return out


def check(spark, rows, length=20, gram=6, **more):
    found = suffix_dedup.remove_repeats(documents(spark, rows), length=length, gram=gram, **more).collect()
    want = brute(rows, length)
    assert len(found) == len(rows)
    for r in found:
        key = (-1 if r["doc_id"] is None else r["doc_id"], (r["text"] or "").encode())
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept_bytes"])) == want[key], key
        assert r["size"] == 2


def corpus(seed, n=60):
    rng = random.Random(seed)
    passage, rows = prose(seed, 9), []
    for i in range(n):
        text = prose(seed * 1000 + i, rng.randrange(0, 30))
        kind = rng.randrange(7)
        if kind == 0:
            text = text[: len(text) // 2] + passage + text[len(text) // 2 :]
        elif kind == 1 and rows:
            text = rng.choice(rows)[1] or ""
        elif kind == 2:
            text = (text[:13] or "ab") * rng.randrange(1, 30)
        elif kind == 3 and rows:
            other = rng.choice(rows)[1] or ""
            text += other[rng.randrange(len(other) + 1) :]
        elif kind == 4:
            text = "aé" * rng.randrange(30)
        rows.append((i, text))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_brute_force(spark, seed):
    check(spark, corpus(seed))


def test_window_by_window_gives_the_same(spark):
    check(spark, corpus(4), most_runs=1)


def test_nulls_empty_repeated_and_ties(spark):
    text = prose(9, 40)
    check(spark, [(1, None), (2, ""), (3, "a"), (5, text), (5, text), (4, text[10:90]), (6, "x" * 300), (6, prose(10, 30)), (None, text[:50])])


def test_null_ids_may_come_last(spark):
    text = prose(9, 40)
    found = suffix_dedup.remove_repeats(documents(spark, [(5, text), (None, text)]), nulls_last=True).collect()
    assert {r["doc_id"]: r["n_removed"] for r in found} == {5: 0, None: len(text)}


def anchors(rows):
    columns = list(zip(*rows))
    kinds = [pa.int64()] * 5 + [pa.int32()] * 2 + [pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], suffix_dedup._ANCHOR)


def test_a_large_group_streams_through():
    given = passed = 0

    def batches():
        nonlocal given
        for k in range(50):
            given += 100
            yield anchors([(7, k * 100 + j, k, 1, j, 0, 3, False) for j in range(100)])

    for out in suffix_dedup.sifted_runs(batches(), 200):
        passed += out.num_rows
        assert given - passed <= 200 and set(out.column("runs").to_pylist()) <= {201}
    assert passed == given == 5000


def test_sifting_is_the_same_however_rows_are_batched():
    rng = np.random.default_rng(3)
    rows = [(int(g), int(r), int(i), 1, int(p), 0, 3, False) for g, r, i, p in rng.integers(0, [12, 6, 4, 3], (300, 4))]
    rows = sorted(rows + [(5, 1, 9, 1, 1, 0, 3, True)] + rows[:40], key=lambda r: (r[0], r[7], *r[1:5]))
    runs = {g: len({r[1] for r in rows if r[0] == g and not r[7]}) for g in range(12)}
    firsts, want = set(), []
    for r in sorted(set(rows), key=lambda r: (r[0], r[7], *r[1:5])):
        if r[7] or r[:2] in firsts:
            want.append((r[0], 0, *r[2:7]))
        elif not firsts.add(r[:2]) and runs[r[0]] > 1:
            want.append((r[0], min(runs[r[0]], 5), *r[2:7]))
    for size in (1, 7, 1000):
        parts = (anchors(rows[k : k + size]) for k in range(0, len(rows), size))
        found = [tuple(d.values()) for out in suffix_dedup.sifted_runs(parts, 4) for d in out.to_pylist()]
        assert sorted((g, min(n, 5), *rest) for g, n, *rest in found) == sorted(want), size


def test_repeated_rows_do_not_multiply_anchors(spark, monkeypatch):
    inner, counts = suffix_dedup._with_bytes, []

    def counted(*args):
        found = inner(*args)
        counts.append(found.count())
        return found

    monkeypatch.setattr(suffix_dedup, "_with_bytes", counted)
    passage = prose(31, 9)
    rows = [(i or None, prose(40 + i, 6) + passage + prose(60 + i, 6)) for i in range(5)]
    check(spark, rows)
    check(spark, rows + rows[:2] * 6)
    assert counts[0] == counts[1] > 0


def test_long_text_and_edge_of_length(spark):
    text = prose(11, 4000)
    check(spark, [(1, text), (2, text[500:9000] + "#" + text[100:119]), (3, text[200:220])], length=20)


def test_characters_stay_whole(spark):
    shared = "é" * 15
    rows = [(1, "a" + shared + "ü"), (2, "\u00aa" + shared + "ö")]
    for r in suffix_dedup.remove_repeats(documents(spark, rows), length=20, gram=6, whole_characters=True).collect():
        bytes(r["kept_bytes"]).decode()


def test_empty_table(spark):
    assert suffix_dedup.remove_repeats(documents(spark, [])).collect() == []
