import json
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from helpers import documents, prose

from catalogloom.llm import best_fit, token_ids
from catalogloom.llm.token_counts import load_tokenizer

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def odd_texts():
    return [None, "", " ", "a  b   c \n\n d", "\0 x", "x<|endoftext|> y", "née  　 z  q", "tab\t end ", "\r\n \r\n", prose(3, 9000), "x" * 50_000]


def corpus():
    rng = random.Random(1)
    rows = [(i, prose(i, rng.choice([3, 20, 60, 150, 400]))) for i in range(150)]
    return rows + [(1000 + k, t) for k, t in enumerate(odd_texts())] + [(7, prose(7, 60)), (7, prose(7, 60)), (None, "no id")]


def layout(spark, rows, **kwargs):
    found = best_fit.pack(documents(spark, rows), BYTES, **kwargs).collect()
    sequences = {}
    for r in found:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at and length > 0
            at += length
        assert at <= kwargs.get("window", 2048)
    return found, len(sequences)


@pytest.mark.parametrize("shape", [{}, {"window": 256, "group": 16, "slack": 4}])
def test_pieces_and_layout(spark, shape):
    rows, window = corpus(), shape.get("window", 2048)
    found, _ = layout(spark, rows, **shape)
    tokenizer, want = load_tokenizer(BYTES), []
    for i, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        first = len(ids) % window or window
        edges = [0, *range(min(first, len(ids)), len(ids) + 1, window)]
        for k, (a, b) in enumerate(zip(edges, edges[1:])):
            want.append((i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found), key=str) == sorted(want, key=str)


def test_little_padding(spark):
    found, used = layout(spark, corpus(), window=512, group=32)
    whole = best_fit.best_fit(np.array([r["length"] for r in found]), 512)[0]  # all pieces as one group
    assert used <= 1.03 * len(set(whole.tolist()))


def test_groups_meet_and_rounds_end(spark):
    small = [(i, prose(i, 2)) for i in range(400)]
    found, used = layout(spark, small, window=1024, group=8)
    assert used <= 1.1 * -(-sum(r["length"] for r in found) // 1024)  # far fewer than the 50 groups
    large = [(i, prose(i, 36)) for i in range(60)]  # over half a window each: nothing can meet
    lengths = [r["length"] for r in layout(spark, large, window=128, group=4)[0]]
    assert min(lengths) > 64
    assert layout(spark, large, window=128, group=4)[1] == len(lengths)
    assert layout(spark, [])[0] == []


def test_best_fit_takes_the_fullest_bin():
    bins, offsets = best_fit.best_fit(np.array([6, 5, 4, 3, 2, 10]), 10)
    assert bins.tolist() == [0, 1, 0, 1, 1, 5] and offsets.tolist() == [0, 0, 6, 5, 8, 0]


def test_ids_are_those_of_the_library():
    texts = [t or "" for t in odd_texts()] + [prose(k, 30) + "\n " + prose(k, 3) for k in range(20)]
    texts += [c * 20_000 for c in (" ", "\n", "1", "!", "é", "\u3000", "\u200b", "😀")] + ["it's IT'S we'll x\u0301y \u0661\u0662 ½ Ⅷ ªº _a_", "\ufeff\x85\x1c a"]
    for path in (BYTES, WORDS):
        tokenizer = load_tokenizer(path)
        want = [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
        assert token_ids.encoder(path)(texts) == want


def test_other_files_are_left_to_the_library():
    spec = json.loads(load_tokenizer(BYTES).to_str())
    assert len(token_ids.merge_ranks(spec)) == 50_256
    assert token_ids.merge_ranks(json.loads(load_tokenizer(WORDS).to_str())) is None
    assert token_ids.merge_ranks(spec | {"pre_tokenizer": spec["pre_tokenizer"] | {"add_prefix_space": True}}) is None
    assert token_ids.merge_ranks(spec | {"model": spec["model"] | {"merges": spec["model"]["merges"][::-1]}}) is None
