"""Session settings for local runs and tests. On a cluster the session comes from the caller."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", app: str = "catalogloom", memory: str = "8g") -> SparkSession:
    """A local session with the settings the operators are written for."""
    partitions = 8 if cores == "*" else max(2, int(cores))
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def settle(df: DataFrame, path: str, mode: str = "overwrite", partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet and return the stored table.

    Used wherever a recomputation would be wrong (paid provider calls) or wasteful (a stage edge):
    everything downstream reads the files, so a lost executor re-reads instead of re-calling.
    """
    spark, schema = df.sparkSession, df.schema
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(schema).parquet(path)


def settle_missing(rows: DataFrame, path: str, keys: list[str], make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Everything stored under ``path`` after adding ``make(rows)`` for the keys not stored yet."""
    try:
        held = rows.sparkSession.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return settle(make(rows), path)
    return settle(make(rows.join(held.select(*keys), keys, "left_anti")), path, mode="append")


_local: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, a temporary one locally."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="spark-catalog-"))
    return _local[0]


def shared_table(df: DataFrame) -> DataFrame:
    """``df`` settled in the shared folder until the session ends, for plans that read it twice.

    What depends on the layout of a shuffle (range bounds, partition numbers) is the same for every
    reader, and a lost executor reads files again.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/catalog-{uuid.uuid4().hex}"
    held = settle(df, path, mode="error")
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return held
