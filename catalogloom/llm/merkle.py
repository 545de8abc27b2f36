"""A Merkle manifest of a dataset, its proofs found by pointer jumping.

Every row is a leaf. Leaves of a group, in order of their ids, are hashed in runs of ``arity`` to the
group's subroot; subroots, in order of the groups, to the root. Subtrees of ``height`` levels are hashed
in one task each, so a deep tree takes few shuffles and a group of any size is spread over all tasks.

A node holds a segment: the digests of its siblings, and a pointer to its parent. Repeated self-joins
double the distance of the pointers and join the segments end to end, until every node reaches the root.
A leaf's proof is its own siblings followed by the segment of its parent.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .blocks import whole_groups
from .common import Arrow, stored, temporary
from .order import positions

_NODE = "tree long, level int, pos long, n long, digest binary, segment binary, id long, claimed binary"
#: The tree over the subroots; trees of groups are numbered from 0 in order of the groups.
TOP = -1


def leaf_digest(values: Sequence[Column]) -> Column:
    """SHA-256 of the values as text, each ``-`` if null, else its UTF-8 byte count, ``:`` and itself."""
    parts = [v.cast("string") for v in values]
    shown = [F.coalesce(F.concat(F.octet_length(p).cast("string"), F.lit(":"), p), F.lit("-")) for p in parts]
    return F.unhex(F.sha2(F.concat(*shown).cast("binary"), 256))


def joined(digests: Sequence[bytes]) -> bytes:
    """The digest of a run of nodes: SHA-256 over their digests as lowercase hex text."""
    return hashlib.sha256(b"".join(digests).hex().encode()).digest()


def _grow(nodes: DataFrame, arity: int, height: int) -> DataFrame:
    """``nodes`` of one level and up to ``height`` levels above, each with its segment.

    The last level has no segments: it goes on to the next call, or it is the top of its tree (n = 1). A
    leaf that is the only one of its tree stands for itself with an empty segment, and as that top.
    """

    def climb(tree: int, level: int, pos: int, n: int, digests: list[bytes], out: list[tuple]) -> None:
        for step in range(height + 1):
            if n == 1 or step == height:
                out.extend((tree, level, pos + k, n, d, None) for k, d in enumerate(digests))
                return
            above = []
            for at in range(0, len(digests), arity):
                run = digests[at : at + arity]
                for k, d in enumerate(run):
                    segment = bytes((k, len(run) - 1 - k)) + b"".join(run[:k]) + b"".join(run[k + 1 :])
                    out.append((tree, level, pos + at + k, n, d, segment))
                above.append(joined(run))
            digests, level, pos, n = above, level + 1, pos // arity, -(-n // arity)

    def run(batches: Arrow) -> Arrow:
        for table, begins in whole_groups(batches, ["tree", "block"]):
            tree, pos, n, level = (table.column(c).to_pylist() for c in ("tree", "pos", "n", "level"))
            digest, ids, claimed = (table.column(c).to_pylist() for c in ("digest", "id", "claimed"))
            out: list[tuple] = []
            for start, end in zip(begins[:-1].tolist(), begins[1:].tolist()):
                found: list[tuple] = []
                climb(tree[start], level[start], pos[start], n[start], digest[start:end], found)
                if claimed[start] is None:  # inner nodes
                    out += [(*node, None, None) for node in found]
                    continue
                if n[start] == 1:
                    out.append((*found[0][:5], b"", ids[start], claimed[start]))
                    out.append((*found[0], None, None))
                    continue
                out += [(*node, i, c) for node, i, c in zip(found, ids[start:end], claimed[start:end])]
                out += [(*node, None, None) for node in found[end - start :]]
            columns = list(zip(*out)) or [()] * 8
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.binary()]
            names = [field.split()[0] for field in _NODE.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    keyed = nodes.withColumn("block", F.expr(f"pos div {arity**height}"))
    laid = keyed.repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")
    return laid.select("tree", "block", "pos", "n", "level", "digest", "id", "claimed").mapInArrow(run, _NODE)


def _tree(nodes: DataFrame, arity: int, height: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """All nodes with segments, and the tops, of the trees over ``nodes``."""
    settled, tops = [], []
    while True:  # a turn for every ``height`` levels
        grown = stored(_grow(nodes, arity, height))
        settled.append(grown.where("segment is not null"))
        tops.append(grown.where("segment is null and n = 1"))
        nodes = grown.where("segment is null and n > 1")
        if nodes.isEmpty():
            return settled, tops


def _all(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for more in tables[1:]:
        out = out.unionByName(more)
    return out


def _with_parent(nodes: DataFrame, arity: int) -> DataFrame:
    """Adds (to_tree, to_level, to_pos). The top of a group's tree is the node of its subroot in ``TOP``."""
    ends = F.col("n") <= arity
    leaves_tree = ends & (F.col("tree") != TOP)
    return nodes.select(
        "*",
        F.when(leaves_tree, F.lit(TOP)).otherwise(F.col("tree")).cast("long").alias("to_tree"),
        F.when(leaves_tree, F.lit(0)).otherwise(F.col("level") + 1).cast("int").alias("to_level"),
        F.when(leaves_tree, F.col("tree")).otherwise(F.expr(f"pos div {arity}")).cast("long").alias("to_pos"),
    )


def _jumped(nodes: DataFrame) -> DataFrame:
    """(tree, level, pos, segment, subroot): segments that reach the root, by doubling pointers.

    In round k every pointer leads 2^k levels up or has reached the root. A node finds the node it points
    to, appends that one's segment to its own and takes over its pointer.
    """
    columns = ["tree", "level", "pos", "segment", "subroot", "to_tree", "to_level", "to_pos"]
    done = stored(nodes.where("to_tree is null").select(*columns))  # the root
    active = stored(nodes.where("to_tree is not null").select(*columns))
    finished, reach = [done], 1
    while not active.isEmpty():
        # Only nodes that high up are pointed to; those of ``TOP`` may be at any distance.
        targets = _all([active, *finished]).where((F.col("level") >= reach) | (F.col("tree") == TOP))
        renamed = targets.select(*[F.col(c).alias(f"next_{c}") for c in columns])
        on = [F.col(f"to_{c}") == F.col(f"next_{c}") for c in ("tree", "level", "pos")]
        moved = active.join(renamed, on).select(
            "tree", "level", "pos",
            F.concat("segment", "next_segment").alias("segment"),
            F.coalesce("subroot", "next_subroot").alias("subroot"),
            *[F.col(f"next_to_{c}").alias(f"to_{c}") for c in ("tree", "level", "pos")],
        )
        moved = stored(moved)
        finished.append(moved.where("to_tree is null"))
        active, reach = moved.where("to_tree is not null"), reach * 2
    return _all(finished).select("tree", "level", "pos", "segment", "subroot")


def manifest(
    docs: DataFrame,
    columns: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"),
    id_col: str = "doc_id",
    group_col: str = "source",
    claimed: Column | None = None,
    arity: int = 3,
    height: int = 6,
) -> DataFrame:
    """(id, leaf, subroot, root, proof, claimed) of every row of ``docs``, digests as bytes.

    A leaf is ``leaf_digest`` of ``columns``. ``proof`` holds, level by level from the leaf to the root,
    how many siblings stand left and right of the node (a byte each) and their digests. ``claimed`` is a
    digest to be verified later (see ``folded``), the leaf itself if not given.

    Null values are ``-`` in a leaf. A null id comes before all others, a null group before all others;
    groups go by their UTF-8 bytes. Rows of equal id go by their leaf, equal rows are leaves of their own,
    in any order. A group of one row is its own subroot, a single group's subroot the root; an empty table
    gives an empty one. Columns not named are not read, so their names cannot clash.
    """
    with temporary():
        leaf = leaf_digest([F.col(c) for c in columns])
        rows = docs.select(
            F.col(id_col).cast("long").alias("id"),
            F.col(group_col).cast("string").alias("group"),
            leaf.alias("digest"),
            (leaf if claimed is None else F.coalesce(claimed, leaf)).alias("claimed"),
        )
        rows = stored(rows.withColumn("tie", F.monotonically_increasing_id()))
        if rows.isEmpty():
            schema = "leaf binary, subroot binary, root binary, proof binary, claimed binary"
            return docs.sparkSession.createDataFrame([], f"`{id_col}` long, {schema}")
        rows = positions(rows, [F.asc_nulls_first("group"), F.asc_nulls_first("id"), F.asc("digest"), F.asc("tie")])
        groups = stored(rows.groupBy("group").agg(F.min("at").alias("start"), F.count("*").alias("n")))
        groups = stored(positions(groups, [F.asc_nulls_first("group")]).withColumnRenamed("at", "tree"))
        groups = groups.withColumnRenamed("group", "of")
        leaves = rows.join(groups, F.col("group").eqNullSafe(F.col("of"))).select(
            "tree", F.lit(0).alias("level"), (F.col("at") - F.col("start")).alias("pos"), "n", "digest", "id", "claimed"
        )
        settled, tops = _tree(leaves, arity, height)
        subroots = _all(tops).select(
            F.lit(TOP).cast("long").alias("tree"), F.lit(0).alias("level"), F.col("tree").alias("pos"),
            F.lit(groups.count()).cast("long").alias("n"), "digest", "id", "claimed",
        )
        upper, top = _tree(subroots, arity, height)
        root = _all(top).first()
        nodes = _with_parent(_all([t.where("claimed is null") for t in settled + upper]), arity)
        nothing = [F.lit(None).cast(kind).alias(f"to_{c}") for c, kind in (("tree", "long"), ("level", "int"), ("pos", "long"))]
        crown = _all(top).withColumn("segment", F.lit(b"")).select("*", *nothing)
        nodes = nodes.unionByName(crown).withColumn("subroot", F.when((F.col("tree") == TOP) & (F.col("level") == 0), F.col("digest")))
        paths = _jumped(nodes).withColumnRenamed("segment", "rest")
        leaves = _with_parent(_all([t.where("claimed is not null") for t in settled]), arity).drop("tree", "level", "pos")
        found = leaves.join(paths, [F.col(f"to_{c}") == F.col(c) for c in ("tree", "level", "pos")]).select(
            F.col("id").alias(id_col), F.col("digest").alias("leaf"), "subroot", F.lit(bytes(root["digest"])).alias("root"),
            F.concat("segment", "rest").alias("proof"), "claimed",
        )
        return stored(found, outlive=True)


def fold(leaf: bytes, proof: bytes) -> tuple[bytes, bytes]:
    """The root that ``leaf`` and the siblings of ``proof`` lead to, and the siblings end to end."""
    at, siblings = 0, []
    while at < len(proof):
        left, right = proof[at], proof[at + 1]
        middle, end = at + 2 + 32 * left, at + 2 + 32 * (left + right)
        siblings.append(proof[at + 2 : end])
        leaf = joined([proof[at + 2 : middle], leaf, proof[middle:end]])
        at = end
    return leaf, b"".join(siblings)


def folded(manifested: DataFrame) -> DataFrame:
    """Adds to ``manifest``'s rows (proof_sha256, folded_root, verified), digests as bytes.

    ``folded_root`` is what the claimed leaf and the proof lead to; it is verified if that is the root.
    """

    def run(batches: Arrow) -> Arrow:
        for batch in batches:
            out = []
            for leaf, proof in zip(batch.column("claimed").to_pylist(), batch.column("proof").to_pylist()):
                root, siblings = fold(leaf, proof)
                out.append((hashlib.sha256(siblings.hex().encode()).digest(), root))
            columns = list(zip(*out)) or [()] * 2
            more = [pa.array(c, pa.binary()) for c in columns]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "proof_sha256", "folded_root"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in manifested.schema)
    done = manifested.mapInArrow(run, f"{schema}, proof_sha256 binary, folded_root binary")
    return done.withColumn("verified", F.col("folded_root") == F.col("root"))
