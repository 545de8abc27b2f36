"""Best-fit packing in a tree of rounds.

Texts longer than a window are cut into windows and a first, shorter piece. Groups of pieces are packed
best fit, longest first, each group on its own. Bins that are nearly full are sequences. The others are
the items of the next round, in which groups hold bins of several groups before, until one group holds
all that is left or a round joins next to nothing. A bin keeps its layout when it moves as an item.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .blocks import whole_groups
from .common import Arrow, by_bytes, kept, stored, temporary, text_of
from .token_ids import encoder


def cut(length: int, window: int) -> list[tuple[int, int]]:
    """(start, end) of the pieces of a text of ``length`` ids: windows, after a first piece of the rest."""
    first = length % window or min(length, window)
    edges = [0, *range(first, length + 1, window)]
    return list(zip(edges[:-1], edges[1:]))


def piece_table(docs: DataFrame, tokenizer: str, window: int, end_id: int, id_col: str, text_col: str, batch_chars: int = 1 << 18) -> DataFrame:
    """(id, piece, start, length, ids_crc32) of every row; ids are little-endian 32-bit numbers in the checksum."""

    def run(batches: Arrow) -> Arrow:
        encode = kept(("ids", tokenizer), lambda: encoder(tokenizer))
        last = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows: list[tuple] = []
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for low, high in by_bytes(texts, batch_chars):
                for key, found in zip(keys[low:high], encode(texts[low:high])):
                    ids = found + last
                    for number, (start, end) in enumerate(cut(len(ids) // 4, window)):
                        rows.append((key, number, start, end - start, zlib.crc32(ids[4 * start : 4 * end])))
            columns = list(zip(*rows)) or [()] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For each item its bin (the number of the bin's first item) and its place there: longest first, fullest bin that has room."""
    n = len(lengths)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    open_bins: list[list[int]] = [[] for _ in range(window + 1)]  # by room left
    rooms = 0  # bit r: some bin has exactly r left
    for item in np.lexsort((np.arange(n), -lengths)).tolist():
        length = int(lengths[item])
        fitting = rooms >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1  # the least room that is enough
            own = open_bins[room].pop()
            if not open_bins[room]:
                rooms &= ~(1 << room)
        else:
            room, own = window, item
        bins[item], offsets[item] = own, window - room
        if room > length:
            open_bins[room - length].append(own)
            rooms |= 1 << (room - length)
    return bins, offsets


def _packed(items: DataFrame, window: int, groups: int, salt: int) -> DataFrame:
    """Adds (bin, shift, fill) to (item, length, ...): the bin's name, the item's place in it, what the bin holds."""
    names = items.columns

    def run(batches: Arrow) -> Arrow:
        for table, begins in whole_groups(batches, ["group"]):
            ids, lengths = table.column("item").to_numpy(), table.column("length").to_numpy()
            bins, shifts, fills = (np.zeros(len(ids), np.int64) for _ in range(3))
            for start, end in zip(begins[:-1].tolist(), begins[1:].tolist()):
                own, shift = best_fit(lengths[start:end], window)
                fill = np.zeros(end - start, np.int64)
                np.add.at(fill, own, lengths[start:end])
                bins[start:end], shifts[start:end], fills[start:end] = ids[start:end][own], shift, fill[own]
            for batch in table.select(names).append_column("bin", pa.array(bins)).append_column("shift", pa.array(shifts)).append_column("fill", pa.array(fills)).to_batches(1 << 14):
                yield batch

    group = F.pmod(F.xxhash64("item", F.lit(salt)), F.lit(groups))
    laid = items.withColumn("group", group).repartition("group").sortWithinPartitions("group", "item")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in items.schema)
    return laid.mapInArrow(run, f"{schema}, bin long, shift long, fill long")


def pack_pieces(pieces: DataFrame, window: int, slack: int, group: int) -> DataFrame:
    """``pieces`` (item, length, ...) with (sequence_id, offset); see ``pack``."""
    first = stored(_packed(pieces.where(F.col("length") < window), window, _groups(pieces, group), 0))
    rounds: list[DataFrame] = []
    at, turn = first, 0
    while True:
        bins = at.where((F.col("item") == F.col("bin")) & (F.col("fill") < window - slack))
        bins = bins.select(F.col("bin").alias("item"), F.col("fill").alias("length"))
        n = bins.count()
        if n < 2:
            break
        turn += 1
        groups = -(-n // group)
        at = stored(_packed(bins, window, groups, turn))
        rounds.append(at)
        joined = at.where(F.col("item") != F.col("bin")).count()
        if groups == 1 or joined * 200 < n:  # all have met, or next to nothing fits
            break
    moved = None  # (item, sequence, by): where each bin of a round ends up
    for step in reversed(rounds):
        step = step.select("item", "bin", "shift")
        if moved is not None:
            later = moved.select(F.col("item").alias("bin"), "sequence", "by")
            step = step.join(later, "bin", "left").select(
                "item", F.coalesce("sequence", "bin").alias("sequence"), (F.col("shift") + F.coalesce("by", F.lit(0))).alias("by")
            )
        else:
            step = step.select("item", F.col("bin").alias("sequence"), F.col("shift").alias("by"))
        moved = stored(step)
    whole = pieces.where(F.col("length") == window).withColumns({"sequence_id": F.col("item"), "offset": F.lit(0).cast("long")})
    if moved is None:
        placed = first.withColumns({"sequence_id": F.col("bin"), "offset": F.col("shift")})
    else:
        moved = moved.where("item <> sequence or by > 0").select(F.col("item").alias("bin"), "sequence", "by")
        placed = first.join(moved, "bin", "left").withColumns(
            {"sequence_id": F.coalesce("sequence", "bin"), "offset": F.col("shift") + F.coalesce("by", F.lit(0))}
        )
    return placed.select(*whole.columns).unionByName(whole)


def _groups(pieces: DataFrame, group: int) -> int:
    return max(1, -(-pieces.count() // group))


def pack(
    docs: DataFrame,
    tokenizer: str,
    window: int = 2048,
    end_id: int = 0,
    slack: int = 8,
    group: int = 8192,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: (id, piece, start, length, ids_crc32, sequence_id, offset).

    A row's ids are those of its text and ``end_id``. Only rows of more than ``window`` ids are cut: into
    windows, the first piece being what is left over. A round packs groups of about ``group`` items; bins
    with at most ``slack`` ids of room are done, the others go on to the next round. Rounds end when one
    group holds every bin left, or when a round has joined less than one bin in 200: then the bins are too
    full to meet, however many there are, and no task ever holds more than a group.

    Null text counts as empty: one piece with the end id. Repeated rows and ids are packed row by row, a
    null id is passed on, an empty table gives no pieces; other columns are not read.
    """
    with temporary():
        pieces = piece_table(docs, tokenizer, window, end_id, id_col, text_col)
        pieces = stored(pieces.withColumn("item", F.monotonically_increasing_id()))
        placed = pack_pieces(pieces, window, slack, group)
        return stored(placed.select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset"), outlive=True)
