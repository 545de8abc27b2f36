"""Removal of repeated byte strings by induced sorting of suffixes.

A suffix array over all texts would hold every suffix. Here a sample of them is sorted, and the
others are induced from it, as induced sorting does with the leftmost suffixes of its kind:

* In every window of ``length`` bytes the ``gram``-byte string of lowest hash is the window's anchor.
  Equal windows have their anchor at equal places, so equal windows meet at equal anchors.
* Suffixes that begin at anchors met more than once are sorted by Spark's external sort, which holds
  the queue of suffix tuples (text, place, anchor, bytes) on disk; neighbours carry the length of
  their common prefix.
* Windows that begin before their anchor are induced from it one byte at a time: the class of a
  suffix is its first byte with the class of the suffix after it. Left class and common prefix give
  the classes of equal windows; all but the first window of a class are repeats.

Runs of windows that are equal as a whole are joined to one before any of this, so copies of a
passage cost nothing there however many they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .blocks import whole_groups
from .common import Arrow, by_bytes, stored, temporary, text_of
from .jaccard_join import _powers, mixed

_BASE = np.uint64(0xE7037ED1A0B428DB)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _sums(data: np.ndarray) -> np.ndarray:
    """Running sums whose differences, brought to a common power, name byte strings."""
    values = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25))[data] * _powers(_BASE, len(data))
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])


def anchor_runs(texts: list[bytes], length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, place, low, high, gram name, run name) of every anchor.

    The anchor at ``place`` serves the windows that begin ``low`` to ``high`` bytes before it; the run
    name stands for all the bytes of these windows and for low and high.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    n = len(data)
    if n < length:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int32, np.int32, np.int64, np.int64))
    sums, back = _sums(data), _powers(_INVERSE, n + 1)
    grams = mixed((sums[gram:] - sums[:-gram]) * back[: n - gram + 1])
    span = length - gram + 1
    bits = np.uint64(max(1, int(n).bit_length()))
    keys = (grams >> bits) << bits | np.arange(len(grams), dtype=np.uint64)
    # The lowest key of every ``span`` neighbours: suffix lows of one block with prefix lows of the next.
    blocks = -(-len(keys) // span) + 1
    padded = np.full(blocks * span, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(keys)] = keys
    square = padded.reshape(blocks, span)
    ahead = np.minimum.accumulate(square, axis=1).reshape(-1)
    behind = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    windows = n - length + 1
    low_key = np.minimum(behind[:windows], ahead[span - 1 : span - 1 + windows])
    anchor = (low_key & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    begin = np.cumsum(sizes) - sizes
    text = np.repeat(np.arange(len(texts)), sizes)
    valid = text[:windows] == text[length - 1 :]
    anchor[~valid] = -1
    change = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    until = np.concatenate([change[1:], [windows]])
    real = anchor[change] >= 0
    first, last = change[real], until[real] - 1
    place = anchor[first]
    high, low = place - first, place - last
    run = mixed((sums[last + length] - sums[first]) * back[first] + mixed((high * 1000 + low + 1).astype(np.uint64)))
    return text[first], place - begin[text[first]], low.astype(np.int32), high.astype(np.int32), grams[place].view(np.int64), run.view(np.int64)


_ANCHOR = ["gram", "run", "id", "text_key", "place", "low", "high", "copy"]


_SIFTED = ["gram", "runs", "id", "text_key", "place", "low", "high"]
_FIRST = [c for c in _SIFTED if c != "runs"]


def _anchors(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """Anchors of all texts. Of equal runs in a batch all but the first are marked ``copy`` at once.

    So a passage found everywhere sends one row per batch to its place; copies are spread out.
    """

    def run(batches: Arrow) -> Arrow:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            ids, keys = batch.column("id").to_numpy(), batch.column("text_key").to_numpy()
            parts = []
            for start, end in by_bytes(texts, 1 << 20):
                of, place, low, high, name, whole = anchor_runs(texts[start:end], length, gram)
                parts.append((name, whole, ids[start + of], keys[start + of], place, low, high))
            columns = [np.concatenate(c) for c in zip(*parts)]
            if not columns:
                continue
            order = np.lexsort((columns[4], columns[3], columns[2], columns[1], columns[0]))
            columns = [c[order] for c in columns]
            copy = np.concatenate([[False], (columns[0][1:] == columns[0][:-1]) & (columns[1][1:] == columns[1][:-1])])[: len(order)]
            again = np.zeros(len(order), bool)  # the same text met twice is no copy
            again[1:] = np.logical_and.reduce([c[1:] == c[:-1] for c in columns[:5]])
            columns[0] = np.where(copy, mixed((columns[2] * 31 + columns[4]).view(np.uint64)).view(np.int64), columns[0])
            yield pa.RecordBatch.from_arrays([pa.array(c[~again]) for c in (*columns, copy)], _ANCHOR)

    schema = "gram long, run long, id long, text_key long, place long, low int, high int, copy boolean"
    return rows.select("id", "text_key", F.col("text").cast("binary").alias("text")).mapInArrow(run, schema)


def sifted_runs(batches: Arrow, most_runs: int) -> Arrow:
    """The anchors that matter (see ``_sifted``) of batches sorted by (gram, copy, run, id, text_key, place).

    No group is held as a whole: of the open one only the first row of each run, ``most_runs`` of them
    at most. A group of more goes on as it comes, each with the number ``most_runs`` + 1.
    """
    last: dict | None = None  # the row before
    held: dict | None = None  # first rows of the runs of the open group
    over = None  # the open group, if it has too many
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in _ANCHOR}
        before = {c: np.concatenate([v[:1] if last is None else last[c], v[:-1]]) for c, v in columns.items()}
        copy = columns["copy"].astype(bool)
        same = ~copy & ~before["copy"].astype(bool) & (columns["gram"] == before["gram"]) & (columns["run"] == before["run"])
        same[0] &= last is not None
        again = np.logical_and.reduce([same, *(columns[c] == before[c] for c in ("id", "text_key", "place"))])
        last = {c: v[-1:].copy() for c, v in columns.items()}
        whole, first = copy | (same & ~again), ~copy & ~same
        parts = [{c: columns[c][whole] for c in _FIRST} | {"runs": np.zeros(int(whole.sum()), np.int64)}]
        fresh = {c: columns[c][first] for c in _FIRST}
        if over is not None:
            still = fresh["gram"] == over
            parts.append({c: v[still] for c, v in fresh.items()} | {"runs": np.full(int(still.sum()), most_runs + 1)})
            fresh = {c: v[~still] for c, v in fresh.items()}
        if len(fresh["gram"]):
            over = None
            if held is not None:
                fresh = {c: np.concatenate([held[c], v]) for c, v in fresh.items()}
            gram = fresh["gram"]
            begins = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
            runs = np.repeat(np.diff(begins), np.diff(begins))
            some = np.flatnonzero(runs > 1)
            parts.append({c: v[some] for c, v in fresh.items()} | {"runs": runs[some]})
            held = {c: v[begins[-1] :].copy() for c, v in fresh.items()}
            if len(held["gram"]) > most_runs:
                parts.append(held | {"runs": np.full(len(held["gram"]), most_runs + 1)})
                held, over = None, gram[-1]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([p[c] for p in parts])) for c in _SIFTED], _SIFTED)
    if held is not None and len(held["gram"]) > 1:
        held["runs"] = np.full(len(held["gram"]), len(held["gram"]))
        yield pa.RecordBatch.from_arrays([pa.array(held[c]) for c in _SIFTED], _SIFTED)


def _sifted(anchors: DataFrame, most_runs: int) -> DataFrame:
    """(gram, runs, id, text_key, place, low, high) of the anchors that matter.

    Copies of whole runs have ``runs`` 0; of an anchor with several different runs the first of each
    stays, with their number (any number above ``most_runs`` stands for all such). All other anchors go.
    """

    def run(batches: Arrow) -> Arrow:
        yield from sifted_runs(batches, most_runs)

    dealt = anchors.repartition("gram").sortWithinPartitions("gram", "copy", "run", "id", "text_key", "place")
    return dealt.mapInArrow(run, "gram long, runs long, id long, text_key long, place long, low int, high int")


def repeated_windows(tails: list[bytes], high: np.ndarray, low: np.ndarray, group: np.ndarray, order: np.ndarray, length: int) -> list[np.ndarray]:
    """For each row the numbers o, from low to high, whose window repeats an earlier one.

    ``tails`` are the bytes of all windows of a row; ``group`` its anchor's group; rows come sorted by
    (group, bytes from the anchor on), ``order`` ranks them by where they stand in the corpus.
    """
    n = len(tails)
    size = np.array([len(t) for t in tails], np.int64)
    wide = np.zeros((n, int(size.max(initial=0)) + 1), np.uint8)
    wide[np.arange(wide.shape[1]) < size[:, None]] = np.frombuffer(b"".join(tails), np.uint8)
    # Common prefix of each anchored suffix with the one before it; none across groups.
    reach = size - high
    right = np.take_along_axis(wide, np.minimum(high[:, None] + np.arange(length), wide.shape[1] - 1), axis=1)
    differ = right[1:] != right[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), length)
    common = np.concatenate([[0], np.minimum(common, np.minimum(reach[1:], reach[:-1]))])
    common[1:][group[1:] != group[:-1]] = 0
    left = group.astype(np.int64)
    marks = np.zeros((n, int(high.max(initial=0)) + 1), bool)
    for o in range(int(high.max(initial=0)) + 1):
        if o:  # one byte further to the left
            on = np.flatnonzero(high >= o)
            left[on] = np.unique(left[on] * 256 + wide[on, high[on] - o], return_inverse=True)[1]
        active = np.flatnonzero((low <= o) & (high >= o))
        if len(active) < 2:
            continue
        classes = left[active] * (n + 1) + np.cumsum(common < length - o)[active]
        by = np.lexsort((order[active], classes))
        repeat = np.concatenate([[False], classes[by][1:] == classes[by][:-1]])
        marks[active[by[repeat]], o] = True
    return [np.flatnonzero(m) for m in marks]


def _induced(suffixes: DataFrame, length: int) -> DataFrame:
    """(id, text_key, start, end): bytes that the repeated windows of each group cover."""

    def run(batches: Arrow) -> Arrow:
        for table, begins in whole_groups(batches, ["gram"]):
            ids, keys, place, low, high = (table.column(c).to_numpy() for c in ("id", "text_key", "place", "low", "high"))
            twice = np.zeros(len(ids), bool)  # a text that is met twice stands next to itself
            twice[1:] = (ids[1:] == ids[:-1]) & (keys[1:] == keys[:-1]) & (place[1:] == place[:-1])
            group = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
            order = np.empty(len(ids), np.int64)
            order[np.lexsort((place, keys, ids))] = np.arange(len(ids))
            marks = repeated_windows(table.column("bytes").to_pylist(), high.astype(np.int64), low.astype(np.int64), group, order, length)
            out = []
            for row, found in enumerate(marks):
                if len(found) and not twice[row]:
                    cut = np.flatnonzero(np.diff(found) > 1)
                    for a, b in zip(np.concatenate([[0], cut + 1]).tolist(), np.concatenate([cut, [len(found) - 1]]).tolist()):
                        out.append((ids[row], keys[row], place[row] - found[b], place[row] - found[a] + length))
            columns = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["id", "text_key", "start", "end"])

    columns = suffixes.select("gram", "id", "text_key", "place", "low", "high", "bytes")
    return columns.mapInArrow(run, "id long, text_key long, start long, end long")


def _by_window(suffixes: DataFrame, length: int) -> DataFrame:
    """As ``_induced``, window by window: for anchors with more different runs than a task should hold."""
    each = suffixes.withColumn("o", F.explode(F.sequence("low", "high")))
    window = F.substring(F.col("bytes"), F.col("high") - F.col("o") + 1, F.lit(length))
    start = (F.col("place") - F.col("o")).alias("start")
    each = each.select("gram", "o", F.xxhash64(window, F.lit(1)).alias("w"), F.xxhash64(window, F.lit(2)).alias("x"), "id", "text_key", start)
    each = stored(each.distinct())
    firsts = stored(each.groupBy("gram", "o", "w", "x").agg(F.count("*").alias("n"), F.min(F.struct("id", "text_key", "start")).alias("first")).where("n > 1"))
    repeats = each.join(firsts, ["gram", "o", "w", "x"]).where(F.struct("id", "text_key", "start") != F.col("first"))
    return repeats.select("id", "text_key", "start", (F.col("start") + length).alias("end"))


def _once(rows: DataFrame) -> DataFrame:
    """``rows`` with one of those that repeat id and text; no others are moved."""
    key = ["id", "text_key"]
    again = stored(rows.groupBy(*key).count().where("count > 1").select(*key))
    many = stored(rows.join(again, key, "left_semi").dropDuplicates(key))
    return rows.join(again, key, "left_anti").unionByName(many)


def _with_bytes(rows: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """Adds to each wanted anchor the bytes of its windows, read from the texts."""
    places = wanted.groupBy("id", "text_key").agg(F.collect_list(F.struct("place", "low", "high", "gram", "runs")).alias("anchors"))
    joined = rows.join(stored(places), ["id", "text_key"])
    data = F.col("text").cast("binary")
    return joined.select("id", "text_key", F.explode("anchors").alias("a"), data.alias("data")).select(
        "id", "text_key", "a.*",
        F.substring("data", F.col("a.place") - F.col("a.high") + 1, F.col("a.high") - F.col("a.low") + length).alias("bytes"),
        F.substring("data", F.col("a.place") + 1, length - F.col("a.low")).alias("right"),
    )


def repeated_spans(rows: DataFrame, length: int, gram: int, most_runs: int) -> DataFrame:
    """(id, text_key, start, end): spans of bytes to remove, overlapping or not, of (id, text_key, text)."""
    rows = _once(rows)
    sifted = stored(_sifted(_anchors(rows, length, gram), most_runs))
    start, end = F.col("place") - F.col("high"), F.col("place") - F.col("low") + length
    copies = sifted.where("runs = 0").select("id", "text_key", start.alias("start"), end.alias("end"))
    suffixes = stored(_with_bytes(rows, sifted.where("runs > 1"), length))
    few = suffixes.where(F.col("runs") <= most_runs).repartition("gram").sortWithinPartitions("gram", "right", "id", "text_key", "place")
    single = _by_window(suffixes.where(F.col("runs") > most_runs), length)
    return copies.unionByName(_induced(few, length)).unionByName(single)


def remove_repeats(
    docs: DataFrame,
    length: int = 100,
    gram: int = 32,
    most_runs: int = 20_000,
    whole_characters: bool = False,
    nulls_last: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """All columns of ``docs`` and (n_bytes, n_removed, n_spans, kept_bytes binary).

    Texts are taken as UTF-8 bytes. A byte goes if it lies in a string of ``length`` bytes that also
    begins earlier: in a row of smaller id, or before in the same text. ``kept_bytes`` is what stays,
    end to end; it may part a character, unless ``whole_characters`` takes parted ones out, too. Texts shorter than ``length`` stay whole. An anchor with more
    than ``most_runs`` different surroundings is resolved window by window instead of in one task; the
    result is the same.

    Null text counts as empty and null ids as smaller than all others, or with ``nulls_last`` as larger. Rows that repeat id and text
    are one document, each gets its result; of rows with one id and different texts an arbitrary but
    fixed one comes first. An empty table gives an empty one. Input columns with the names of result
    columns are replaced. String names are 64-bit hashes.
    """
    own = ["n_bytes", "n_removed", "n_spans", "kept_bytes"]
    columns = [c for c in docs.columns if c not in own]
    key = [F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1 if nulls_last else -(1 << 63))).alias("id"), F.xxhash64(text_of(text_col)).alias("text_key")]
    rows = docs.select(*key, text_of(text_col).alias("text"))
    with temporary():
        spans = repeated_spans(rows, length, gram, most_runs)
        spans = stored(spans.groupBy("id", "text_key").agg(F.collect_list(F.struct("start", "end")).alias("spans")), outlive=True)
    # The row travels as one column, so that no name of its own clashes with a helper's.
    joined = docs.select(F.struct(*columns).alias("row"), *key).join(spans, ["id", "text_key"], "left")
    data = F.coalesce(F.col("row")[text_col], F.lit("")).cast("binary")
    flat = joined.select(*[F.col("row")[c].alias(f"c{k}") for k, c in enumerate(columns)], data.alias("data"), "spans")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*columns).schema)

    def run(batches: Arrow) -> Arrow:
        n = len(columns)
        for batch in batches:
            out: list[tuple] = []
            for data, spans in zip(batch.column(n).to_pylist(), batch.column(n + 1).to_pylist()):
                data = data or b""
                if not spans:
                    out.append((len(data), 0, 0, data))
                    continue
                edge = np.zeros(len(data) + 1, np.int64)
                at = np.array([(s["start"], s["end"]) for s in spans])
                np.add.at(edge, at[:, 0], 1)
                np.add.at(edge, at[:, 1], -1)
                gone = np.cumsum(edge[:-1]) > 0
                if whole_characters:
                    character = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80) - 1
                    gone = (np.bincount(character, gone) > 0)[character]
                runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                out.append((len(data), int(gone.sum()), runs, np.frombuffer(data, np.uint8)[~gone].tobytes()))
            found = list(zip(*out)) or [()] * 4
            arrays = [pa.array(c, k) for c, k in zip(found, [pa.int64(), pa.int64(), pa.int64(), pa.binary()])]
            yield pa.RecordBatch.from_arrays([*list(batch.columns)[:n], *arrays], [*columns, *own])

    return flat.mapInArrow(run, f"{fields}, n_bytes long, n_removed long, n_spans long, kept_bytes binary")
