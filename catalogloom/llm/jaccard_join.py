"""Jaccard join on word shingles with Bayesian pruning.

Documents of equal shingle sets form a class. Class signatures of minimum hashes are cut into bands;
classes that share a band are compared hash by hash, and a pair is dropped as soon as it is too
unlikely to reach the threshold. What survives joins classes into narrow candidate groups, within
which the surviving pairs are verified exactly on their shingle sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .blocks import Forest, dealt, pairs, together, whole_groups
from .common import Arrow, by_bytes, stored, temporary, text_of
from .embedding_dedup import first_meeting
from .graph import components

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of ``x`` spread over all bits (a bijection on 64-bit numbers)."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _rolled(texts: list[str], words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words, of all runs of ``words`` of them, and where each text's words begin."""
    data = np.frombuffer("\n".join([*(t.lower() for t in texts), ""]).encode(), np.uint8)
    n = len(data)
    base = np.uint64(0xD6E8FEB86659FD93)
    inverse = np.uint64(pow(int(base), -1, 1 << 64))
    values = mixed(np.arange(1, 257, dtype=np.uint64) * _MULTIPLIER)[data] * _powers(base, n)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    solid = ~_WHITE[data]
    edges = np.diff(np.concatenate([[0], solid.view(np.int8), [0]]))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    hashed = mixed((sums[ends] - sums[starts]) * _powers(inverse, n + 1)[starts]) if len(starts) else np.zeros(0, np.uint64)
    lengths = np.array([len(t.lower().encode()) + 1 for t in texts])
    first = np.searchsorted(starts, np.concatenate([[0], np.cumsum(lengths)]))
    rolled = np.zeros(max(0, len(hashed) - words + 1), np.uint64)
    for k in range(words):
        rolled += hashed[k : k + len(rolled)] * mixed(np.uint64([k + 1]))[0]
    return hashed, mixed(rolled), first


def shingle_sets(texts: list[str], words: int) -> list[np.ndarray]:
    """The sorted 64-bit hashes of each text's shingles of ``words`` lower-case words.

    Words are what ASCII white space parts. A text of fewer words is one shingle, one without words none.
    """
    hashed, rolled, first = _rolled(texts, words)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= words:
            out.append(np.unique(rolled[a : b - words + 1]))
        elif b > a:
            part = hashed[a:b] * mixed(np.arange(1, b - a + 1, dtype=np.uint64))
            out.append(mixed(part.sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(shingles: np.ndarray, multipliers: np.ndarray, strip: int = 2048) -> np.ndarray:
    """The smallest hash of the set under each multiplier (all ones for the empty set)."""
    low = np.full(len(multipliers), 0xFFFFFFFF, np.uint64)
    for at in range(0, len(shingles), strip):
        low = np.minimum(low, ((shingles[at : at + strip, None] * multipliers) >> np.uint64(32)).min(axis=0))
    return low.astype(np.uint32)


def multipliers(hashes: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, size=hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def set_key(shingles: np.ndarray) -> int:
    """A 64-bit name of the set; equal sets have equal names."""
    at = np.arange(1, len(shingles) + 1, dtype=np.uint64) * _MULTIPLIER
    total = mixed(shingles ^ at).sum(dtype=np.uint64) + np.uint64(len(shingles))
    return int(mixed(np.array([total], np.uint64)).view(np.int64)[0])


def least_matches(threshold: float, hashes: int, step: int, tolerance: float) -> np.ndarray:
    """For each number of compared hashes (a multiple of ``step``) the fewest matches a pair may have.

    With a uniform prior the posterior of the match rate is a Beta distribution; below the fewest
    matches its mass above the threshold is under ``tolerance``. Hashes are compared on 8 bits, of
    which 1/256 agree by chance.
    """
    rate = threshold + (1 - threshold) / 256
    grid = (np.arange(20_000) + 0.5) / 20_000
    out = []
    for n in range(step, hashes + 1, step):
        m = np.arange(n + 1)[:, None]
        logs = m * np.log(grid) + (n - m) * np.log1p(-grid)
        mass = np.exp(logs - logs.max(axis=1, keepdims=True))
        above = mass[:, grid >= rate].sum(axis=1) / mass.sum(axis=1)
        out.append(int(np.argmax(above >= tolerance)))
    return np.array(out)


def likely(bits: np.ndarray, i: np.ndarray, j: np.ndarray, least: np.ndarray, step: int) -> np.ndarray:
    """Numbers of the pairs that stay likely through all rounds of comparing ``step`` more hashes."""
    alive, matches = np.arange(len(i)), np.zeros(len(i), np.int32)
    for turn, few in enumerate(least.tolist()):
        at = slice(turn * step, (turn + 1) * step)
        matches += (bits[i[alive], at] == bits[j[alive], at]).sum(axis=1)
        ok = matches >= few
        alive, matches = alive[ok], matches[ok]
    return alive


def linked(codes: np.ndarray, edge: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float, flags: np.ndarray) -> np.ndarray:
    """Which pairs have a Jaccard similarity of at least ``threshold``; row r is codes[edge[r]:edge[r+1]]."""
    size = np.diff(edge)
    small, large = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
    maybe = np.flatnonzero(small >= threshold * large)
    out = np.zeros(len(i), bool)
    order = maybe[np.argsort(i[maybe], kind="stable")]
    bounds = np.flatnonzero(np.diff(i[order], prepend=-1, append=-1))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        run = order[a:b]
        mine = codes[edge[i[run[0]]] : edge[i[run[0]] + 1]]
        flags[mine] = True
        for s in range(0, len(run), 512):
            part = run[s : s + 512]
            sizes = size[j[part]]
            begin = np.cumsum(sizes) - sizes
            at = np.arange(int(sizes.sum())) + np.repeat(edge[j[part]] - begin, sizes)
            both = np.add.reduceat(flags[codes[at]].astype(np.int64), begin)
            out[part] = both >= threshold * (len(mine) + sizes - both)
        flags[mine] = False
    return out


def _signed(docs: DataFrame, words: int, hashes: int, bands: int, seed: int) -> DataFrame:
    """(id, text_key, set, n, bits, buckets): name and size of each shingle set, its hashes to 8 bits, its bands."""

    def run(batches: Arrow) -> Arrow:
        factor = multipliers(hashes, seed)
        mix = multipliers(hashes // bands, seed + 1)
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for start, end in by_bytes(texts, 1 << 20):
                sets = shingle_sets(texts[start:end], words)
                low = np.stack([signature(s, factor) for s in sets])
                band = (mixed((low.reshape(len(sets), bands, -1) * mix).sum(axis=2, dtype=np.uint64)) >> np.uint64(32)).astype(">u4")
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(start, end - start),
                        batch.column(1).slice(start, end - start),
                        pa.array([set_key(s) for s in sets], pa.int64()),
                        pa.array([len(s) for s in sets], pa.int32()),
                        pa.array([r.tobytes() for r in low.astype(np.uint8)], pa.binary()),
                        pa.array([r.tobytes() for r in band], pa.binary()),
                    ],
                    ["id", "text_key", "set", "n", "bits", "buckets"],
                )

    rows = docs.select("id", "text_key", "text")
    return rows.mapInArrow(run, "id long, text_key long, set long, n int, bits binary, buckets binary")


def _bytes_matrix(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def _candidates(groups: DataFrame, least: np.ndarray, step: int) -> DataFrame:
    """(a, b): classes of one band joined by likely pairs."""

    def run(batches: Arrow) -> Arrow:
        for table, begins in whole_groups(batches, ["key", "lo", "hi"]):
            ids = table.column("id").to_numpy()
            lo, hi, side = (table.column(c).to_numpy() for c in ("lo", "hi", "side"))
            codes, bits = _bytes_matrix(table.column("buckets"), ">u4"), _bytes_matrix(table.column("bits"), np.uint8)
            of = table.column("key").to_numpy() >> 32
            forest = Forest(len(ids))
            for i, j in pairs(begins, lo, hi, side):
                apart = np.flatnonzero(forest.label[i] != forest.label[j])  # joined already: nothing new
                i, j = i[apart], j[apart]
                keep = first_meeting(codes, of, i, j)
                keep = keep[likely(bits, i[keep], j[keep], least, step)]
                forest.join(i[keep], j[keep])
            at = np.flatnonzero(forest.label != np.arange(len(ids)))
            yield pa.RecordBatch.from_arrays([pa.array(ids[forest.label[at]]), pa.array(ids[at])], ["a", "b"])

    return groups.select("key", "lo", "hi", "side", "id", "bits", "buckets").mapInArrow(run, "a long, b long")


def _verified(groups: DataFrame, threshold: float, least: np.ndarray, step: int) -> DataFrame:
    """(id, leader, links): exact links of the classes of a group, and a class each is joined to."""

    def run(batches: Arrow) -> Arrow:
        for table, begins in whole_groups(batches, ["key", "lo", "hi"], 1024):
            ids, copies = table.column("id").to_numpy(), table.column("copies").to_numpy()
            lo, hi, side = (table.column(c).to_numpy() for c in ("lo", "hi", "side"))
            bits = _bytes_matrix(table.column("bits"), np.uint8)
            lists = table.column("shingles").combine_chunks()
            edge = np.concatenate([[0], np.cumsum(np.diff(lists.offsets.to_numpy()))]).astype(np.int64)
            names, codes = np.unique(lists.flatten().to_numpy(), return_inverse=True)
            flags = np.zeros(len(names), bool)
            links, forest = np.zeros(len(ids), np.int64), Forest(len(ids))
            for i, j in pairs(begins, lo, hi, side):
                keep = likely(bits, i, j, least, step)
                i, j = i[keep], j[keep]
                keep = linked(codes, edge, i, j, threshold, flags)
                i, j = i[keep], j[keep]
                np.add.at(links, i, copies[j])
                np.add.at(links, j, copies[i])
                forest.join(i, j)
            at = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[at]), pa.array(ids[forest.label[at]]), pa.array(links[at])], ["id", "leader", "links"]
            )

    columns = groups.select("key", "lo", "hi", "side", "id", "copies", "bits", "shingles")
    return columns.mapInArrow(run, "id long, leader long, links long")


def _members(texts: DataFrame, words: int) -> DataFrame:
    """Adds the shingles of (id, copies, bits, key, text); a text of another set with the same id goes."""

    def run(batches: Arrow) -> Arrow:
        for batch in batches:
            texts, wanted = batch.column("text").to_pylist(), batch.column("id").to_pylist()
            for start, end in by_bytes(texts, 1 << 20):
                sets = shingle_sets(texts[start:end], words)
                at = [k for k, s in enumerate(sets) if set_key(s) == wanted[start + k]]
                part = batch.slice(start, end - start).take(pa.array(at, pa.int64()))
                shingles = pa.array([sets[k].view(np.int64) for k in at], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("id", "copies", "bits", "key")), shingles], ["id", "copies", "bits", "key", "shingles"])

    rows = texts.select("id", "copies", "bits", "key", "text")
    return rows.mapInArrow(run, "id long, copies long, bits binary, key long, shingles array<long>")


def join_documents(
    docs: DataFrame,
    threshold: float = 0.8,
    words: int = 5,
    hashes: int = 128,
    bands: int = 32,
    step: int = 32,
    tolerance: float = 1e-6,
    seed: int = 5,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(id, class_id, n_links, component_id, kept, text_key) of every document.

    ``class_id`` is the smallest id of the documents with the same shingle set, ``n_links`` how many
    other documents have a Jaccard similarity of ``threshold`` or more, ``component_id`` the smallest
    id reachable by links. A pair exactly at 0.8 is missed by all bands with probability 5e-8 and
    pruned with less than ``tolerance``; every reported link is exact. ``kept`` is the row of the smallest
    id in its component, by its text where several rows have that id; ``text_key`` is the hash of the text.

    Texts without words (null, empty, blank) are equal to each other. A text of fewer than ``words``
    words is a single shingle. Rows repeating an id count as documents of their own, and so do rows
    without id: they link like others, come after all ids, and give a null where no row has an id. Rows
    of equal id and text are kept or not alike. An empty table gives an empty one; other columns are
    not read. Classes keep copies together however many there are; groups of any size are dealt out in
    pairs of blocks.
    """
    with temporary():
        least = least_matches(threshold, hashes, step, tolerance)
        text = text_of(text_col)
        rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
        signed = stored(_signed(rows, words, hashes, bands, seed))
        # Ids in order, rows without id last; the text tells rows of one id apart.
        place = F.struct(F.col("id").isNull().alias("no"), F.col("id").alias("id"), F.col("text_key").alias("text_key"))
        classes = signed.groupBy("set").agg(
            F.min(place).alias("first"), F.count("*").alias("copies"), F.any_value("n").alias("n"),
            F.any_value("bits").alias("bits"), F.any_value("buckets").alias("buckets"),
        )
        classes = stored(classes.withColumnRenamed("set", "id"))
        part = F.conv(F.hex(F.substring("buckets", F.col("band") * 4 + 1, F.lit(4))), 16, 10).cast("long")
        keyed = (
            classes.where("n > 0")
            .select("id", "buckets", F.explode(F.sequence(F.lit(0), F.lit(bands - 1))).alias("band"))
            .withColumn("key", F.shiftleft(F.col("band").cast("long"), 32) + part)
            .drop("band")
        )
        groups = dealt(keyed, classes.select("id", "bits", "buckets"), F.lit(1), 512)
        close = components(stored(_candidates(together(groups), least, step)))
        narrow = classes.join(close.select(F.col("node").alias("id"), F.col("component").alias("key")), "id")
        narrow = narrow.select("id", "copies", "bits", "key", F.col("first.id").alias("of"), F.col("first.text_key").alias("text_key"))
        rows = rows.select(F.col("id").alias("own"), F.col("text_key").alias("own_key"), "text")
        texts = rows.join(narrow.hint("merge"), (F.col("own_key") == F.col("text_key")) & F.col("own").eqNullSafe(F.col("of")))
        texts = texts.select("id", "copies", "bits", "key", "text")
        members = stored(_members(texts, words).dropDuplicates(["id"]))
        groups = dealt(members, members.drop("key"), F.size("shingles"), 100_000)
        found = stored(_verified(together(groups), threshold, least, step))
        sets = components(found.select(F.col("leader").alias("a"), F.col("id").alias("b")))
        stats = (
            classes.select("id", "copies", "first")
            .join(found.groupBy("id").agg(F.sum("links").alias("links")), "id", "left")
            .join(sets.withColumnRenamed("node", "id"), "id", "left")
            .select("id", "first", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component"))
        )
        lowest = stats.groupBy("component").agg(F.min("first").alias("lowest"))
        stats = stats.join(lowest, "component").select(F.col("id").alias("set"), "first", "n_links", "lowest")
        result = signed.select("id", "text_key", "set").join(stats, "set").select(
            F.col("id").alias(id_col),
            F.col("first.id").alias("class_id"),
            F.col("n_links").cast("long").alias("n_links"),
            F.col("lowest.id").alias("component_id"),
            (F.col("id").eqNullSafe(F.col("lowest.id")) & (F.col("text_key") == F.col("lowest.text_key"))).alias("kept"),
            "text_key",
        )
        return stored(result, outlive=True)
