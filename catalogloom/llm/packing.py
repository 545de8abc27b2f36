"""Packing: shallow length combinations, their repeat counts by non-negative least squares.

Texts are cut into pieces of at most one window; full windows are sequences already. The rest is a
histogram over length classes. Combinations of up to ``depth`` classes that fill a window are
enumerated, non-negative least squares finds how often each is repeated, the counts are rounded down
and what is left is packed greedily, combination by combination. All of this works on the histogram,
whose size is fixed by the window; pieces then find their place by their rank within their class.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import Arrow, by_bytes, kept, stored, text_of
from .token_counts import load_tokenizer, splits_of
from .token_ids import encoder


def _word_ends(tokenizer) -> np.ndarray:
    """For each id: does its token end a match of the pattern?"""
    ends = np.zeros(max(tokenizer.get_vocab().values()) + 1, bool)
    ends[[i for token, i in tokenizer.get_vocab().items() if token.endswith("</w>")]] = True
    return ends


def _fill(cache: dict[bytes, bytes], missing: set[bytes], tokenizer, ends: np.ndarray) -> None:
    """Adds the ids of ``missing`` words to ``cache``."""
    missing |= {m for m in (b".", b",") if m not in cache}
    # A word and the mark after it are separate matches of the pattern.
    marked = {w for w in missing if w[-1:] in (b".", b",") and w[:-1].isalpha()}
    plain = [w.decode() for w in (missing - marked) | {w[:-1] for w in marked if w[:-1] not in cache}]
    letters = [w for w in plain if w.isalpha()]
    others = [w for w in plain if not w.isalpha()]
    # A word of letters is one match, so many can be encoded as one text and parted where tokens end words.
    ids = np.array(tokenizer.encode_batch_fast([" ".join(letters)], add_special_tokens=False)[0].ids, "<u4")
    cuts = np.flatnonzero(ends[ids]) + 1
    if len(cuts) == len(letters):
        data, at = ids.tobytes(), 0
        for word, cut in zip(letters, (4 * cuts).tolist()):
            cache[word.encode()] = data[at:cut]
            at = cut
    else:  # lower case has made several matches of some word
        others = plain
    for word, found in zip(others, tokenizer.encode_batch_fast(others, add_special_tokens=False)):
        cache[word.encode()] = np.array(found.ids, "<u4").tobytes()
    for word in marked:
        cache[word] = cache[word[:-1]] + cache[word[-1:]]


def ids_by_words(texts: list[str], tokenizer, ends: np.ndarray, cache: dict[bytes, bytes], most_cached: int = 3 << 18) -> list[bytes]:
    """Token ids of each text as little-endian 32-bit numbers.

    The tokenizer lowers case, drops ASCII white space and never reaches across it, so each word is
    encoded once and the ids are joined. ``cache`` is emptied when full.
    """
    split = []
    for text in texts:
        data = text.encode()
        split.append((data if b"<|" in data else data.lower()).split())  # a special string is matched before case is lowered
    missing = set().union(*split).difference(cache)
    if len(cache) + 2 * len(missing) > most_cached:
        cache.clear()
        missing = set().union(*split)
    if missing:
        _fill(cache, missing, tokenizer, ends)
    return [b"".join(map(cache.__getitem__, words)) for words in split]


def piece_table(docs: DataFrame, tokenizer: str, window: int, end_id: int, id_col: str, text_col: str, batch_chars: int = 1 << 18) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens): every text cut into windows and a rest."""

    def run(batches: Arrow) -> Arrow:
        loaded, cache = load_tokenizer(tokenizer), kept(("words", tokenizer), dict)
        if kept(("splits", tokenizer), lambda: splits_of(loaded)) == "words":
            ends = kept(("word ends", tokenizer), lambda: _word_ends(loaded))
            encode = lambda texts: ids_by_words(texts, loaded, ends, cache)
        else:
            encode = kept(("ids", tokenizer), lambda: encoder(tokenizer))
        last = np.array([end_id], "<u4").tobytes()
        step = window * 4
        for batch in batches:
            rows: list[tuple] = []
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for low, high in by_bytes(texts, batch_chars):
                for key, found in zip(keys[low:high], encode(texts[low:high])):
                    ids = found + last
                    for at in range(0, len(ids), step):
                        part = ids[at : at + step]
                        rows.append((key, at // 4, len(part) // 4, zlib.crc32(part), len(ids) // 4))
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in columns], ["id", "start", "length", "ids_crc32", "doc_tokens"]
            )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, start long, length long, ids_crc32 long, doc_tokens long")


def combinations(classes: int, depth: int) -> list[tuple[int, ...]]:
    """Multisets of at most ``depth`` of the classes 1..classes that sum to ``classes`` exactly."""
    out: list[tuple[int, ...]] = []

    def grow(chosen: tuple[int, ...], left: int, most: int) -> None:
        if left == 0:
            out.append(chosen)
        elif len(chosen) + 1 == depth:
            if left <= most:
                out.append((*chosen, left))
        elif len(chosen) < depth:
            for c in range(min(left, most), -(-left // (depth - len(chosen))) - 1, -1):
                grow((*chosen, c), left - c, c)

    grow((), classes, classes)
    return out


def non_negative_least_squares(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """x >= 0 that minimises ``|a x - b|``: active sets, grown by the steepest column, cut at zero."""
    gram, target = a.T @ a, a.T @ b
    x, active = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    least = 1e-9 * max(1.0, float(np.abs(target).max(initial=0)))
    for _ in range(rounds):
        slope = np.where(active, -np.inf, target - gram @ x)
        best = int(np.argmax(slope))
        if slope[best] <= least:
            break
        active[best] = True
        while True:
            chosen = np.flatnonzero(active)
            z = np.linalg.lstsq(gram[np.ix_(chosen, chosen)], target[chosen], rcond=None)[0]
            if (z > 0).all():
                x[:] = 0
                x[chosen] = z
                break
            falling = z <= 0
            share = np.min(x[chosen][falling] / np.maximum(x[chosen][falling] - z[falling], 1e-300))
            x[chosen] += share * (z - x[chosen])
            gone = chosen[(x[chosen] <= 1e-12) & falling]
            x[gone], active[gone] = 0, False
            if not len(gone):
                break
    return x


def plan_windows(histogram: np.ndarray, depth: int) -> list[tuple[tuple[int, ...], int]]:
    """(classes, repeats) whose pieces together are exactly ``histogram`` (count of class c at c - 1)."""
    size = len(histogram)
    left = histogram.astype(np.int64).copy()
    strategies = combinations(size, depth)
    a = np.zeros((size, len(strategies)))
    for k, chosen in enumerate(strategies):
        for c in chosen:
            a[c - 1, k] += 1
    plan: list[tuple[tuple[int, ...], int]] = []
    x = non_negative_least_squares(a, left.astype(float)) if left.any() else np.zeros(0)
    for k in np.argsort(-x, kind="stable"):
        need = a[:, k].astype(np.int64)
        used = need > 0
        repeats = min(int(x[k]), int((left[used] // need[used]).min()))
        if repeats > 0:
            left -= repeats * need
            plan.append((strategies[k], repeats))
    while left.any():  # each turn uses up at least one class
        need, room = np.zeros(size, np.int64), size
        for c in range(size, 0, -1):
            if (fit := min(int(left[c - 1]), room // c)) > 0:
                need[c - 1] = fit
                room -= fit * c
        used = need > 0
        repeats = int((left[used] // need[used]).min())
        left -= repeats * need
        plan.append((tuple(np.repeat(np.arange(1, size + 1), need).tolist()[::-1]), repeats))
    return plan


def pack(
    docs: DataFrame,
    tokenizer: str,
    window: int = 2048,
    end_id: int = 1,
    grain: int = 16,
    depth: int = 3,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: (id, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    A row's ids are those of its text and ``end_id``; every id lies in one piece, pieces of a sequence
    lie one after the other from offset 0 and take ``window`` tokens at most. ``grain`` (a divisor of
    ``window``) is the width of a length class: a smaller one wastes less and takes longer to solve.

    Words are encoded once each where the file is a word tokenizer of the known kind (``splits_of``);
    other ``.json`` files get whole texts.

    Null text counts as empty: one piece with the end id. Repeated rows and ids are packed row by
    row, a null id is passed on, an empty table gives no pieces; other columns are not read. Which
    sequence a piece gets is settled by the stored piece table, so every reading of the result agrees.
    """
    spark = docs.sparkSession
    pieces = stored(piece_table(docs, tokenizer, window, end_id, id_col, text_col))
    classes = window // grain
    pieces = pieces.withColumn("size", F.ceil(F.col("length") / grain).cast("int"))
    # Pieces of a class are numbered file by file: counts per file first, then a rank within the file.
    # Nothing orders a whole class in one task.
    pieces = pieces.withColumn("bin", F.pmod(F.xxhash64("id", "start", "ids_crc32"), F.lit(_bins(pieces))).cast("int"))
    counts = pieces.groupBy("size", "bin").agg(F.count("*").alias("n"))
    before = Window.partitionBy("size").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    counts = stored(counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))))
    histogram = np.zeros(classes, np.int64)
    for row in counts.groupBy("size").agg(F.sum("n").alias("n")).collect():  # at most ``classes`` rows
        histogram[row["size"] - 1] = row["n"]
    slots = spark.createDataFrame(*_slots(plan_windows(histogram, depth)))
    rank = Window.partitionBy("size", "bin").orderBy("id", "start", "ids_crc32")
    placed = (
        pieces.withColumn("own", F.row_number().over(rank))
        .join(counts.select("size", "bin", "before"), ["size", "bin"])
        .withColumn("rank", F.col("own") - 1 + F.col("before"))
        .join(F.broadcast(slots), "size")  # one row per class, each with its few intervals
        .withColumn("slot", F.expr("element_at(filter(slots, s -> rank >= s.low and rank < s.high), 1)"))
        .withColumn("sequence_id", F.expr("slot.base + (rank - slot.low) div slot.each"))
        .withColumn("turn", F.expr("(rank - slot.low) % slot.each"))
    )
    within = Window.partitionBy("sequence_id").orderBy(F.desc("size"), "turn")
    offset = F.coalesce(F.sum("length").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return placed.select(
        F.col("id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", offset.alias("offset")
    )


def _bins(pieces: DataFrame) -> int:
    """Bins within a class: about 20,000 pieces each if one class held them all."""
    return max(16, pieces.count() // 20_000)


def _slots(plan: list[tuple[tuple[int, ...], int]]):
    """For each class the intervals of ranks and the sequences they go to, as rows and a schema."""
    base, used, found = 0, {}, {}
    for chosen, repeats in plan:
        for c in sorted(set(chosen)):
            each = chosen.count(c)
            low = used.get(c, 0)
            found.setdefault(c, []).append((low, low + each * repeats, base, each))
            used[c] = low + each * repeats
        base += repeats
    return list(found.items()), "size int, slots array<struct<low: long, high: long, base: long, each: long>>"
