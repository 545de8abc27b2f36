"""Token counts: batches balanced by size go through the tokenizer, only lengths come back."""

from __future__ import annotations

import json
import os
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Arrow, by_bytes, kept, safe_parts, text_of


def load_tokenizer(path: str):
    """The tokenizer of a ``.json`` file, one thread, once per worker."""

    def make():
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        return tokenizer

    return kept(("tokenizer", path), make)


# Fixed value: how word tokenizers with marked word ends cut texts; what is between is dropped.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def splits_of(tokenizer) -> str | None:
    """How a tokenizer cuts texts, if it is one of two known ways: ``bytes`` or ``words``.

    ``bytes`` is the byte-level pattern, nothing normalised. ``words`` lowers case, drops white space and
    marks the ends of words. Both cut before a blank that follows no white space; nothing is known of
    others, which get whole texts.
    """
    spec = json.loads(tokenizer.to_str())
    model, cutter, normal = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("normalizer")
    reaching = [t for t in spec["added_tokens"] if t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or re.search(r"\s", t["content"])]
    if reaching or model.get("type") != "BPE" or model.get("dropout"):
        return None
    level = {"type": "ByteLevel", "add_prefix_space": False}
    if normal is None and cutter.get("use_regex", True) and cutter.items() >= level.items():
        return "bytes"
    split = {"type": "Split", "pattern": {"Regex": WORD_PATTERN}, "behavior": "Removed", "invert": True}
    folding = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
    parts = cutter.get("pretokenizers") or []
    if (
        normal == {"type": "Sequence", "normalizers": folding}
        and len(parts) == 2
        and parts[0] == split
        and parts[1].items() >= (level | {"use_regex": False}).items()
        and model.get("end_of_word_suffix") == "</w>"
    ):
        return "words"
    return None


def _json_lengths(path: str, most_cached: int):
    tokenizer, cache = load_tokenizer(path), kept(("part lengths", path), dict)
    safe_parts_ = safe_parts if kept(("splits", path), lambda: splits_of(tokenizer)) else lambda text: [text]

    def lengths(texts: list[str]) -> list[int]:
        """Parts met before are known; the new ones of all texts are encoded as one batch."""
        parts = [safe_parts_(text) for text in texts]
        missing = list(set().union(*parts).difference(cache))
        if len(cache) + len(missing) > most_cached:
            cache.clear()
            missing = list(set().union(*parts))
        found = tokenizer.encode_batch_fast(missing, add_special_tokens=False)
        cache.update(zip(missing, map(len, found)))
        return [sum(map(cache.__getitem__, p)) for p in parts]

    return lengths


def _piece_lengths(path: str, _: int):
    def make():
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=path)

    processor = kept(("pieces", path), make)
    return lambda texts: [len(x) for x in processor.encode(texts, num_threads=1)]


def count_tokens(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = 512,
    batch_chars: int = 1 << 18,
    most_cached: int = 3 << 18,
) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row of ``docs``.

    ``tokenizer`` is a file: ``.json`` for tokenizers, ``.model`` for sentencepiece. No begin, end or
    other added tokens; special strings inside texts are what the library makes of them by default.
    Batches hold about ``batch_chars`` characters however their rows are spread. Texts are cut where the
    tokenizer cuts anyway, so a long one needs no more memory than its parts, and the lengths of parts
    are remembered, ``most_cached`` at most. A ``.json`` file that cuts in a way not known here, and a
    sentencepiece model, which normalises whole texts, get their texts uncut.

    Null text counts as empty: no bytes, no tokens. A null id is passed on, repeated rows give
    repeated rows, an empty table gives an empty one; other columns are not read.
    """
    load = _json_lengths if tokenizer.endswith(".json") else _piece_lengths

    def lengths(batches: Arrow) -> Arrow:
        count = load(tokenizer, most_cached)
        for batch in batches:
            texts, found = batch.column(1).to_pylist(), []
            for start, end in by_bytes(texts, batch_chars):
                found += count(texts[start:end])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(found, pa.int64())], ["id", "n_bytes", "n_tokens"]
            )

    rows = docs.select(
        F.col(id_col).cast("long").alias("id"),
        text_of(text_col).alias("text"),
        F.octet_length(text_of(text_col)).cast("long").alias("n_bytes"),
    )
    return rows.mapInArrow(lengths, "id long, n_bytes long, n_tokens long").select(
        F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
