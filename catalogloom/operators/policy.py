"""Policy scan: which banned terms occur in which texts."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.pieces import BLANKS, distinct_names, pieces_of
from ..functions.text import fold_case, folded_text, lower_case

# The terms a product-neutral code base must not mention.
BANNED_TERMS = [
    "coloring",
    "coloring pages",
    "battlemap",
    "battle map",
    "dnd",
    "d&d",
    "fantasy",
    "mandala",
    "mandalas",
    "witchy",
    "wizard",
    "dragon",
    "dragon's",
    "etsy",
    "gumroad",
    "kdp",
    "kindle",
    "amazon",
    "ttrpg",
    "printable game",
]

_WORD = r"[\p{L}\p{N}_]"

# The slots that names of terms are marked in, a megabyte of bits, and the bits of one bitmap.
SLOTS = 1 << 23
_BITMAP = 1 << 15


def _quoted(term: str) -> str:
    return re.sub(r"([^\w\s])", r"\\\1", term)


def word_pattern(term: str) -> str:
    """A folded term as a whole word of a folded text.

    Word boundaries are spelled out: the engine's own are ASCII-minded in some versions. The literal
    comes first and looks back over itself, so the search skips to its first letter.
    """
    body = _quoted(term)
    return rf"{body}(?<!{_WORD}{body})(?!{_WORD})"


def scan_banned_terms(
    df: DataFrame,
    text: str,
    keys: Sequence[str],
    terms: Sequence[str] = tuple(BANNED_TERMS),
    mode: str = "word",
) -> DataFrame:
    """One row per (text, term) that occurs. ``mode`` is ``word`` or ``substring``, case ignored.

    No join: terms are part of the plan, so thousands of them are better put in a table for
    ``scan_term_table``; patterns are compiled once, texts never move. Each text is
    folded to one case once; a plain substring search settles nearly all (text, term) pairs, and the
    word pattern runs only where the substring is there.
    """
    body = F.col("_body")
    if mode == "word":
        folded = df.select(*keys, fold_case(F.col(text)).alias("_body"))
        tests = [F.contains(body, F.lit(t)) & body.rlike(word_pattern(t)) for t in map(folded_text, terms)]
    else:
        folded = df.select(*keys, F.lower(F.col(text)).alias("_body"))
        tests = [F.contains(body, F.lower(F.lit(t))) for t in terms]
    found = F.array_compact(F.array(*[F.when(test, F.lit(t)) for test, t in zip(tests, terms)]))
    return folded.select(*keys, F.explode(found).alias("term"))


def words(folded: Column) -> Column:
    """Distinct words of a text already folded to one case."""
    return F.array_distinct(F.regexp_extract_all(folded, F.lit(f"{_WORD}+"), 0))


def _cut(rows: list, most: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of texts with about ``most`` characters each (one text at least)."""
    start = size = 0
    for i, text in enumerate(rows):
        if size and size + len(text) > most:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(rows):
        yield start, len(rows)


def _named_terms(terms: DataFrame) -> DataFrame:
    """(term, n, a, b): how many pieces each term of (term, lower) has, and the name they have together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms, lower = (batch.column(c).to_pylist() for c in (0, 1))
            at = [k for k, f in enumerate(lower) if f.strip(BLANKS) and f[0] not in BLANKS]
            rows = []
            for low, high in _cut([lower[k] for k in at], 1 << 20):
                found = pieces_of([lower[k].rstrip(BLANKS) for k in at[low:high]])
                sizes = np.bincount(found.text, minlength=high - low)
                for n in np.unique(sizes).tolist():
                    own, a, b = found.names(n)
                    rows += [(terms[at[low + t]], n, x, y) for t, x, y in zip(own.tolist(), a.view(np.int64).tolist(), b.view(np.int64).tolist()) if sizes[t] == n]
            columns = list(zip(*rows)) or [()] * 4
            kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["term", "n", "a", "b"])

    return terms.mapInArrow(run, "term string, n int, a long, b long")


def _known_names(named: DataFrame) -> Column:
    """The different numbers of pieces among (term, n, a, b), and the slots that the names fall on.

    The size is bounded whatever the number of terms; the more slots are marked, the less they sort out.
    """
    slot = F.col("a").bitwiseAND(F.lit(SLOTS - 1)) + 1
    bitmaps = named.groupBy(F.bitmap_bucket_number(slot).alias("bitmap")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits"), F.collect_set("n").alias("lengths")
    )
    lengths = F.array_sort(F.array_distinct(F.flatten(F.collect_list("lengths"))))
    return bitmaps.agg(F.struct(lengths.alias("lengths"), F.collect_list(F.struct("bitmap", "bits")).alias("bitmaps"))).scalar()


def _marked(bitmaps: list[dict]) -> np.ndarray:
    """Which slots are marked."""
    marked = np.zeros(SLOTS, bool)
    for held in bitmaps:
        start = (held["bitmap"] - 1) * _BITMAP
        marked[start : start + _BITMAP] = np.unpackbits(np.frombuffer(held["bits"], np.uint8), bitorder="little")
    return marked


def _named_stretches(df: DataFrame, text: str, key: str, known: Column) -> DataFrame:
    """(key, a, b) of the stretches of each text that fall on the slots of ``known`` names, each once per text."""
    # Only the first row of a task brings what is known.
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    texts = df.select(F.col(key), lower_case(F.col(text)).alias("_lower"), F.when(row == 0, known).alias("_known"))

    def rows(keys: pa.Array, parts: list[tuple]) -> pa.RecordBatch:
        own, a, b = (np.concatenate(column) for column in zip(*parts))
        return pa.RecordBatch.from_arrays([keys.take(pa.array(own)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], [key, "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = marked = None
        for batch in batches:
            if batch.num_rows and known is None:
                known = batch.column(2)[0].as_py()
                marked = _marked(known["bitmaps"])
            lower = [f or "" for f in batch.column(1).to_pylist()]
            parts, size = [], 0
            for low, high in _cut(lower, 1 << 16):
                found = pieces_of(lower[low:high])
                for n in known["lengths"]:
                    own, a, b = distinct_names(found, n, marked)
                    parts.append((own + low, a, b))
                    size += len(own)
                    if size >= 1 << 15 or len(parts) >= 1 << 10:
                        yield rows(batch.column(0), parts)
                        parts, size = [], 0
            if parts:
                yield rows(batch.column(0), parts)

    return texts.mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, a long, b long")


def scan_term_table(df: DataFrame, terms: DataFrame, text: str, key: str, term: str = "term", phrases: bool = True) -> DataFrame:
    """One row per (text, term) for a table of terms of any size, as whole words, case ignored.

    An equi join instead of every text against every term. Terms are named by the number of their pieces
    (words and single signs) and a rolling name of what they hold; texts name all their stretches of as
    many pieces, so a text costs its pieces times the different numbers of pieces among the terms, however
    long the terms are. Tasks hold one bit for each slot that a name of a term falls on and give only the
    names that fall there too, each once per text; which of them are terms is settled by the join, for any
    number of terms. Only keys and names meet; no text moves. Names have 128 bits, which is taken for
    equality. Adaptive execution splits a word that is in most texts.

    Blanks after a term do not count; a term that begins with one, or is blank, is found nowhere. A null
    text holds nothing; rows repeating a key are texts of their own. ``phrases=False`` looks for terms of
    one piece only.
    """
    listed = terms.select(F.col(term).alias("term")).filter(F.col("term") != "").distinct()
    named = _named_terms(listed.select("term", lower_case(F.col("term")).alias("lower")))
    if not phrases:
        named = named.filter("n = 1")
    return _named_stretches(df, text, key, _known_names(named)).join(named, ["a", "b"]).select(key, "term")
