"""Readers and writers of the catalog tables: requests, artifacts, run state, images, listings."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from .. import schemas
from ..functions.text import file_stem
from ..operators.images import exif_orientation
from ..operators.incremental import merge_run_states, node_records, run_state
from ..operators.listings import dedupe_listings
from ..operators.requests import derive_product_id, fill_request_defaults, normalize_requests


def read_requests(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Product requests with ids and defaults; CSV holds lists as separated text."""
    if fmt == "csv":
        raw = spark.read.schema(schemas.REQUEST_TEXT).option("header", True).csv(path)
        return derive_product_id(normalize_requests(raw))
    raw = spark.read.schema(schemas.REQUEST).format(fmt).load(path)
    return derive_product_id(fill_request_defaults(raw))


def read_artifacts(spark: SparkSession, path: str) -> DataFrame:
    """Envelopes of ``path/<product>/artifacts/<name>.json``."""
    docs = (
        spark.read.schema(schemas.ENVELOPE)
        .option("multiLine", True)
        .json(f"{path}/*/artifacts/*.json")
        .select("*", F.col("_metadata.file_path").alias("_file"))
    )
    return docs.select(
        F.element_at(F.split("_file", "/"), -3).alias("product_id"),
        file_stem(F.col("_file")).alias("name"),
        F.coalesce("schema_version", F.lit(1)).alias("schema_version"),
        F.to_json("artifact").alias("artifact"),
        F.to_json("provenance").alias("provenance"),
    )


def unwrap(artifacts: DataFrame, name: str, schema: str) -> DataFrame:
    """The artifacts of one name with their document as typed columns."""
    chosen = artifacts.filter(F.col("name") == name)
    return chosen.select("product_id", F.from_json("artifact", schema).alias("doc")).select("product_id", "doc.*")


def write_artifacts(df: DataFrame, path: str, mode: str = "append") -> None:
    """Envelope rows as Parquet, one directory per artifact name.

    The rebalance hint lets adaptive execution cut a large name into several files and merge small
    ones, instead of every task writing a sliver of every name.
    """
    df.hint("rebalance", "name").write.mode(mode).partitionBy("name").parquet(path)


def read_run_state(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Products and their node records from ``path/<product>/product.json``."""
    docs = spark.read.schema(schemas.STATE).option("multiLine", True).json(f"{path}/*/product.json")
    products = docs.select("product_id", F.col("pack_id").alias("pack"), "pack_version", F.to_json("request").alias("request"))
    nodes = docs.select("product_id", F.explode("nodes").alias("stage", "node")).select(
        "product_id",
        "stage",
        "node.status",
        F.coalesce("node.input_hash", F.lit("")).alias("input_hash"),
        F.coalesce("node.output_path", F.lit("")).alias("output_path"),
        F.coalesce("node.cost", F.lit(0.0)).alias("cost"),
        F.coalesce("node.error", F.lit("")).alias("error"),
        F.expr("try_cast(nullif(node.created_at, '') as timestamp)").alias("created_at"),
        F.expr("try_cast(nullif(node.updated_at, '') as timestamp)").alias("updated_at"),
    )
    return products, nodes


def write_run_state(runs: DataFrame, path: str) -> None:
    """Append to the run log; records are never changed in place."""
    runs.write.mode("append").partitionBy("run", "stage").parquet(path)


def read_node_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.NODE_RUNS).parquet(path)


def snapshot_path(path: str) -> str:
    return f"{path}_state"


def last_snapshot(spark: SparkSession, path: str) -> int:
    """The number of the last run that the newest snapshot of a run log covers, 0 without one."""
    try:
        held = spark.read.parquet(snapshot_path(path))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0
    return held.agg(F.max("upto")).first()[0] or 0  # answered from the folder names


def read_run_log_state(spark: SparkSession, path: str, runs: DataFrame | None = None) -> DataFrame:
    """The mergeable state of all of a run log: the newest snapshot and the runs after it.

    Runs are folders of the log, so those that a snapshot covers are not opened.
    """
    log = read_node_runs(spark, path) if runs is None else runs
    upto = last_snapshot(spark, path)
    tail = run_state(log.filter(F.col("run") > upto))
    if not upto:
        return tail
    held = spark.read.parquet(snapshot_path(path)).filter(F.col("upto") == upto).drop("upto")
    return merge_run_states(held, tail)


def write_snapshot(spark: SparkSession, path: str, upto: int) -> None:
    """A snapshot of the runs up to a number, from the one before and the runs in between.

    Runs numbered ``upto`` or less must not be added any more. A snapshot that broke off has no success
    mark and its folder is written anew; readers see it only when it is whole.
    """
    before = last_snapshot(spark, path)
    if upto <= before:
        return
    log = read_node_runs(spark, path).filter(F.col("run") <= upto)
    state = read_run_log_state(spark, path, log)
    draft = f"{snapshot_path(path)}.draft"
    state.write.mode("overwrite").parquet(draft)
    where = lambda name: spark._jvm.org.apache.hadoop.fs.Path(name)
    files = where(draft).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(where(snapshot_path(path)))
    files.rename(where(draft), where(f"{snapshot_path(path)}/upto={upto}"))


def read_node_state(spark: SparkSession, path: str) -> DataFrame:
    """Current record of every node: the newest snapshot merged with the runs after it."""
    return node_records(read_run_log_state(spark, path))


def read_file_stats(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Path and byte size of files; their content is not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True)
    return files.load(path).select(plain_path(F.col("path")).alias("path"), "length")


def plain_path(c: Column, encoded: bool = False) -> Column:
    """A file location without its scheme, as the tables store it; ``encoded`` undoes URL escapes."""
    bare = F.regexp_replace(c, r"\Afile:/+", "/")
    return F.url_decode(F.replace(bare, F.lit("+"), F.lit("%2B"))) if encoded else bare


def write_files(df: DataFrame, root: str) -> DataFrame:
    """Write ``content`` to ``root/<product_id>/<path>`` on the shared mount; returns product_id, path, length, uri.

    Lazy: write or cache the result to run it. Each file appears under its final name in one step,
    so a task that is repeated replaces its files with equal ones.
    """

    def store(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for product, path, content in zip(batch["product_id"], batch["path"], batch["content"]):
                target = os.path.join(root, product, path)
                os.makedirs(os.path.dirname(target), exist_ok=True)
                draft = f"{target}.{os.getpid()}.part"
                with open(draft, "wb") as handle:
                    handle.write(content)
                os.replace(draft, target)
                rows.append((product, path, len(content), target))
            yield pd.DataFrame(rows, columns=["product_id", "path", "length", "uri"])

    return df.select("product_id", "path", "content").mapInPandas(
        store, "product_id string, path string, length bigint, uri string"
    )


def read_images(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Decoded images: path, height, width, channels, data (blue-green-red rows).

    Files that are no image have no row; compare with ``read_file_stats`` to find them.
    """
    return spark.read.format("image").option("dropInvalid", True).load(path).select(
        plain_path(F.col("image.origin"), encoded=True).alias("path"),
        F.col("image.height").alias("height"),
        F.col("image.width").alias("width"),
        F.col("image.nChannels").alias("channels"),
        F.col("image.data").alias("data"),
    )


@F.pandas_udf(T.IntegerType())
def _orientation(content: pd.Series) -> pd.Series:
    return content.map(exif_orientation)


def read_orientations(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Path and EXIF orientation of the images that are not upright; most collections have few.

    The image source decodes without turning. Join this to ``read_images`` by path where turned
    photographs are to be expected.
    """
    files = spark.read.format("binaryFile").load(path)
    head = F.substring("content", 1, 1 << 16)  # the tag stands in the head of a file; no more goes to Python
    turned = files.select(plain_path(F.col("path")).alias("path"), _orientation(head).alias("orientation"))
    return turned.filter(F.col("orientation") > 1)


def write_listings(df: DataFrame, path: str, keys: tuple[str, ...] = ("product_id", "marketplace", "language")) -> None:
    """JSON copies per marketplace and language; the last of repeated listings wins."""
    last = dedupe_listings(df, keys)
    last.hint("rebalance", "marketplace", "language").write.mode("overwrite").partitionBy(
        "marketplace", "language"
    ).json(path)
