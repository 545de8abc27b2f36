"""Content hashes: text, records, node keys, and mergeable digests of file sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..session import shared_table


def content_hash(c: Column) -> Column:
    """SHA-256 of the UTF-8 text, as lower-case hex."""
    return F.sha2(c, 256)


def _canonical(c: Column, kind: T.DataType) -> Column:
    """Order the fields of structs and the entries of maps so equal records give equal text."""
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        rebuilt = F.struct(*[_canonical(c[f.name], f.dataType).alias(f.name) for f in fields])
        return F.when(c.isNull(), F.lit(None)).otherwise(rebuilt)
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda item: _canonical(item, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform(
            F.array_sort(F.map_keys(c)),
            lambda k: F.struct(
                _canonical(k, kind.keyType).alias("key"), _canonical(F.element_at(c, k), kind.valueType).alias("value")
            ),
        )
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):  # JSON text would keep milliseconds only
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return c


def record_text(df: DataFrame, columns: Sequence[str]) -> Column:
    """Key-sorted JSON of the named columns, NULLs kept.

    The names and types are read from the schema only; no job runs.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    parts = [_canonical(F.col(name), kinds[name]).alias(name) for name in sorted(columns)]
    return F.to_json(F.struct(*parts), {"ignoreNullFields": "false"})


def record_hash(df: DataFrame, columns: Sequence[str]) -> Column:
    """SHA-256 of ``record_text``: equal exactly when the records are equal."""
    return content_hash(record_text(df, columns))


def node_key(code_version: Column, prompt_version: Column, config_hash: Column, inputs: Sequence[Column]) -> Column:
    """Key of one stage run: versions, configuration and the sorted input hashes joined by bars.

    The inputs are a fixed list of columns, one per declared input, so no group is ever collected.
    Absent inputs (NULL) drop out.
    """
    head = [F.coalesce(c, F.lit("")) for c in (code_version, prompt_version, config_hash)]
    tail = [F.array_sort(F.array_compact(F.array(*inputs)))] if inputs else []
    return content_hash(F.concat_ws("|", *head, *tail))


def by_name(name: Column, value: Column, names: Sequence[str]) -> list[Column]:
    """One aggregate per declared name that picks the value filed under it.

    A pivot with a plan-time list of names: partial aggregation keeps at most ``len(names)`` values
    per group on either side of the shuffle, however many rows the group holds.
    """
    return [F.max(F.when(name == n, value)).alias(n) for n in names]


# A hash is cut into this many numbers of this many hex digits: 24 bits each, 240 bits together.
LANES = 10
DIGITS = 6


def digest_lanes(hash_hex: Column) -> list[Column]:
    """The leading digits of a hex hash as a fixed list of small numbers."""
    return [F.conv(F.substring(hash_hex, 1 + DIGITS * i, DIGITS), 16, 10).cast("bigint") for i in range(LANES)]


def files_digest(df: DataFrame, keys: Sequence[str], path: str, content_sha: str, out: str = "digest") -> DataFrame:
    """One digest per group of files that depends on each path and its content, not on row order.

    Each file contributes SHA-256(path, content hash); the numbers cut from those hashes are summed
    and the sums hashed. Sums merge, so a group with a third of all files is reduced on every mapper
    to one row before the shuffle, and nothing is sorted or collected. 24-bit numbers in 64-bit sums
    hold 5·10^11 files. A cache key against accidental change, not a signature.
    """
    lanes = [f"_lane{i}" for i in range(LANES)]
    each = df.select(*keys, content_hash(F.concat_ws("|", F.col(path), F.col(content_sha))).alias("_h"))
    each = each.select(*keys, *[c.alias(n) for c, n in zip(digest_lanes(F.col("_h")), lanes)])
    sums = each.groupBy(*keys).agg(F.count(F.lit(1)).alias("files"), *[F.sum(n).alias(n) for n in lanes])
    return sums.select(*keys, "files", content_hash(F.concat_ws("|", "files", *lanes)).alias(out))


def ordered_digest(df: DataFrame, keys: Sequence[str], path: str, content_sha: str, out: str = "digest", fan: int = 1024) -> DataFrame:
    """One digest per group of files that depends on each path, each byte and the order of the paths.

    A tree of hashes over the files in order of their paths: SHA-256(path, content hash) are the leaves,
    runs of ``fan`` neighbours, joined by bars, are hashed until one is left. A group of any size is dealt
    out in runs, so no task holds more than a run, and a changed file changes one hash per level. Files
    are numbered over ranges of paths, which are settled in the shared folder. Null counts as empty text.
    """
    name, place = F.coalesce(F.col(path), F.lit("")), F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)])
    leaf = content_hash(F.concat(name, F.lit("|"), F.coalesce(F.col(content_sha), F.lit(""))))
    files = df.select(place.alias("_key"), name.alias("_path"), leaf.alias("_h"))
    ranged = files.repartitionByRange("_key", "_path", "_h").sortWithinPartitions("_key", "_path", "_h")
    laid = shared_table(ranged.withColumn("_row", F.monotonically_increasing_id()))
    part = F.shiftright("_row", 33)
    # Per range and group: where its rows begin, and how many of the group stand in earlier ranges.
    spans = laid.groupBy("_key", part.alias("_part")).agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.select("_key", "_part", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"))
    numbered = laid.withColumn("_part", part).join(spans, ["_key", "_part"])
    nodes = numbered.select("_key", (F.col("_row") + F.col("_shift")).alias("_pos"), "_h")
    totals = laid.groupBy("_key").agg(F.count("*").alias("files"))
    # As many levels as the largest group needs; a group that is down to one hash passes through.
    most = totals.agg(F.max("files")).first()[0] or 1
    nodes = nodes.join(totals, "_key").withColumn("_left", F.col("files"))
    while most > 1:
        run = F.array_sort(F.collect_list(F.struct("_pos", "_h")))
        hashed = content_hash(F.array_join(F.transform("_run", lambda x: x["_h"]), "|"))
        grouped = nodes.groupBy("_key", F.floor(F.col("_pos") / fan).alias("_pos"), "files", "_left").agg(run.alias("_run"))
        nodes = grouped.select(
            "_key", "_pos", "files",
            F.when(F.col("_left") == 1, F.get("_run", F.lit(0))["_h"]).otherwise(hashed).alias("_h"),
            F.ceil(F.col("_left") / fan).alias("_left"),
        )
        most = -(-most // fan)
    return nodes.select(*[F.col(f"_key.k{i}").alias(k) for i, k in enumerate(keys)], "files", F.col("_h").alias(out))
