import json
import random
import zlib

import numpy as np
import pytest
import tiktoken
from helpers import by_key, documents, prose

import public_tokenizers
from catalogloom.llm import byte_bpe, common, packing, token_counts

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")
WORD_JSON = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")

ODD = [None, "", " ", "\n\n  x", "it's we'll 'tis don''t", " 's x!'re", "a<|endoftext|>b", "漢字 é\u0301 \u00a0\u2003 12٣", "ab" * 3000, "🙂👍🏽 \r\n\t", "<|STARTOFTEXT|> Hi. Hi, hi.", "İSTANBUL ΣΑΣ ab.\u0301", "x\x1cy\x0bz"]


def rows():
    return [(i, t) for i, t in enumerate(ODD)] + [(50, prose(1, 60_000)), (51, prose(2, 30)), (51, prose(2, 30)), (None, "no id")]


def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(RANKS), special_tokens={})


def test_pretokenizer_equals_library():
    rng, lib = random.Random(4), library()
    texts = ["".join(rng.choice("ab'stmdrevl 12\n\t .,!é漢\r\u00a0") for _ in range(rng.randrange(70))) for _ in range(4000)]
    assert byte_bpe.encode_texts(texts, byte_bpe.load_ranks(RANKS), {}) == [lib.encode_ordinary(t) for t in texts]


def test_long_pieces_and_small_cache():
    lib = library()
    texts = ["a" * 5000 + "bé" * 900, "xyz" * 30, prose(3, 50)]
    assert byte_bpe.encode_texts(texts, byte_bpe.load_ranks(RANKS), {}, most_cached=3) == [lib.encode_ordinary(t) for t in texts]


def test_strips_carry_their_state():
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab'stmdrevl 12\n\t .,!é漢") for _ in range(rng.randrange(40))) for _ in range(200)]
    codes = np.array([ord(c) for t in texts for c in t], np.uint32)
    sizes = np.array([len(t) for t in texts])
    first = np.zeros(len(codes), bool)
    first[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
    whole = byte_bpe.piece_starts(codes, first)
    for strip in (1, 2, 3, 7, 64):
        assert (byte_bpe.piece_starts(codes, first, strip) == whole).all()


def test_rows_are_decoded_in_batches(spark):
    encoded = byte_bpe.encode(documents(spark, rows()), RANKS)
    whole = sorted(map(str, byte_bpe.decode(encoded, RANKS).collect()))
    assert sorted(map(str, byte_bpe.decode(encoded, RANKS, batch_bytes=50).collect())) == whole


def test_encode_and_decode(spark):
    lib = library()
    encoded = byte_bpe.encode(documents(spark, rows()), RANKS)
    got = by_key(byte_bpe.decode(encoded, RANKS).collect(), "doc_id")
    for i, text in rows():
        for r in got[i]:
            assert list(r["ids"]) == lib.encode_ordinary(text or "") and bytes(r["decoded"]) == (text or "").encode()
    assert sum(map(len, got.values())) == len(rows())
    for r in encoded.where("size(ids) > 0").collect():
        assert r["ends"][-1] == len((dict(rows())[r["doc_id"]] or "").encode())
    assert byte_bpe.decode(byte_bpe.encode(documents(spark, []), RANKS), RANKS).collect() == []


@pytest.mark.parametrize("path", [JSON, WORD_JSON])
def test_counts_equal_library(spark, path):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(path)
    got = by_key(token_counts.count_tokens(documents(spark, rows()), path, most_cached=300, batch_chars=200).collect(), "doc_id")
    for i, text in rows():
        want = len(lib.encode(text or "", add_special_tokens=False).ids)
        assert all((r["n_tokens"], r["n_bytes"], r["over_limit"]) == (want, len((text or "").encode()), want > 512) for r in got[i]), text
    assert token_counts.count_tokens(documents(spark, []), path).collect() == []


@pytest.fixture(params=["prefix", "strip", "lower"])
def other_file(request, tmp_path):
    """Tokenizer files that cut in ways not known here."""
    spec = json.loads(open(WORD_JSON if request.param == "lower" else JSON).read())
    if request.param == "prefix":
        spec["pre_tokenizer"]["add_prefix_space"] = True
    elif request.param == "strip":
        spec["added_tokens"][0]["lstrip"] = True
    else:
        spec["normalizer"]["normalizers"][1]["content"] = ""  # words run together
    path = tmp_path / "other.json"
    path.write_text(json.dumps(spec))
    return str(path)


def test_other_files_get_whole_texts(spark, other_file):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(other_file)
    assert token_counts.splits_of(lib) is None
    some = [r for r in rows() if r[0] != 50] + [(60, "a  <|endoftext|> b <|endoftext|>")]
    want = {i: [len(lib.encode(t or "", add_special_tokens=False).ids) for j, t in some if j == i] for i, _ in some}
    got = by_key(token_counts.count_tokens(documents(spark, some), other_file).collect(), "doc_id")
    assert {i: [r["n_tokens"] for r in got[i]] for i in got} == want
    packed = by_key(packing.pack(documents(spark, some), other_file).where("start = 0").collect(), "doc_id")
    assert {i: sorted(r["doc_tokens"] - 1 for r in packed[i]) for i in packed} == {i: sorted(n) for i, n in want.items()}


def test_known_files():
    assert token_counts.splits_of(token_counts.load_tokenizer(JSON)) == "bytes"
    assert token_counts.splits_of(token_counts.load_tokenizer(WORD_JSON)) == "words"


def test_counts_of_pieces(spark):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    some = [r for r in rows() if r[0] != 50]
    got = by_key(token_counts.count_tokens(documents(spark, some), PIECES).collect(), "doc_id")
    assert all(r["n_tokens"] == len(lib.encode(text or "")) for i, text in some for r in got[i])


def test_safe_parts():
    text = prose(5, 500) + "  x \n\n y "
    parts = common.safe_parts(text)
    assert "".join(parts) == text and len(parts) > 500
    assert common.safe_parts("x" * 1000) == ["x" * 1000] and common.safe_parts("") == [""]


def test_packing(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(WORD_JSON)
    window = 256
    many = rows() + [(100 + k, prose(k, k % 90)) for k in range(300)]
    frame = packing.pack(documents(spark, many), WORD_JSON, window=window, grain=8)
    got = frame.collect()
    assert sorted(got, key=str) == sorted(frame.collect(), key=str)  # every reading agrees
    want = []
    for i, text in many:
        ids = [*lib.encode(text or "", add_special_tokens=False).ids, 1]
        for s in range(0, len(ids), window):
            part = np.array(ids[s : s + window], "<u4")
            want.append((i, s, len(part), zlib.crc32(part.tobytes()), len(ids)))
    assert sorted([(r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got], key=str) == sorted(want, key=str)
    used = by_key(got, "sequence_id")
    for pieces in used.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= window
    total = sum(r["length"] for r in got)
    assert total / (window * len(used)) > 0.95
    assert packing.pack(documents(spark, []), WORD_JSON).collect() == []


def test_plan_uses_the_whole_histogram():
    rng = np.random.default_rng(1)
    for _ in range(20):
        counts = rng.integers(0, 60, 16) * rng.integers(0, 2, 16)
        left = counts.copy()
        for chosen, repeats in packing.plan_windows(counts, 3):
            assert sum(chosen) <= 16 and repeats > 0
            for c in chosen:
                left[c - 1] -= repeats
        assert not left.any()


def test_least_squares():
    rng = np.random.default_rng(2)
    a, x = rng.random((12, 8)), np.maximum(0, rng.normal(size=8))
    found = packing.non_negative_least_squares(a, a @ x)
    assert (found >= 0).all() and np.allclose(found, x, atol=1e-5)
    b = rng.normal(size=12)
    slope = a.T @ (b - a @ packing.non_negative_least_squares(a, b))
    assert (slope < 1e-6).all()
