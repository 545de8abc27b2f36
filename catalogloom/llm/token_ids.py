"""Token ids of whole texts by a ``.json`` tokenizer.

Plain byte-level BPE files are run by tiktoken's merging, which gives the same ids in half the time; any
other file by the tokenizers library itself.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np

from .token_counts import load_tokenizer

# Fixed value: how byte-level tokenizers cut texts.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_of_sign() -> dict[str, int]:
    """Byte-level files write printable bytes as themselves and the others, in order, from U+0100 on."""
    shown = [b for low, high in (("!", "~"), ("¡", "¬"), ("®", "ÿ")) for b in range(ord(low), ord(high) + 1)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def merge_ranks(spec: dict) -> dict[bytes, int] | None:
    """The ids of all byte strings, if the file is plain byte-level BPE whose merges stand in order of their ids."""
    model, cutter = spec["model"], spec.get("pre_tokenizer") or {}
    plain = (
        model.get("type") == "BPE"
        and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        and spec.get("normalizer") is None
        and cutter.get("type") == "ByteLevel"
        and not cutter.get("add_prefix_space")
        and cutter.get("use_regex", True)
        and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"])
    )
    if not plain:
        return None
    vocab, signs = model["vocab"], byte_of_sign()
    added = {t["content"] for t in spec["added_tokens"]}
    made = [vocab.get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
    in_order = None not in made and all(a < b for a, b in zip(made, made[1:]))
    ranks = {t: i for t, i in vocab.items() if t not in added}
    if not in_order or len(ranks) != len(made) + 256 or any(s not in vocab or vocab[s] >= made[0] for s in signs):
        return None
    return {bytes(signs[c] for c in t): i for t, i in ranks.items()}


def encoder(path: str) -> Callable[[list[str]], list[bytes]]:
    """A function from texts to their ids as little-endian 32-bit numbers, nothing added.

    Special strings inside texts are what the tokenizers library makes of them by default.
    """
    tokenizer = load_tokenizer(path)
    spec = json.loads(tokenizer.to_str())
    ranks = merge_ranks(spec)
    if ranks is None:
        return lambda texts: [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    import tiktoken

    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    merging = tiktoken.Encoding("ids", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return lambda texts: [merging.encode_to_numpy(t, allowed_special="all", disallowed_special=()).astype("<u4").tobytes() for t in texts]
