"""Shared helpers of the training-text operators."""

from __future__ import annotations

import re
import sys
import tempfile
import threading
import types
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

Arrow = Iterator  # of pyarrow.RecordBatch


def kept(key: Any, make: Callable[[], Any]) -> Any:
    """``make()``, once per Python worker: tasks of one worker share tokenizers and tables."""
    box = sys.modules.setdefault("_catalogloom_llm_kept", types.ModuleType("_catalogloom_llm_kept"))
    store = box.__dict__.setdefault("store", {})
    if key not in store:
        store[key] = make()
    return store[key]


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, a temporary one locally."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return kept("local folder", lambda: tempfile.mkdtemp(prefix="spark-llm-"))


_open = threading.local()  # the scopes of ``temporary`` that are open, innermost last


def stored(df: DataFrame, outlive: bool = False) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back.

    Cuts the lineage: a lost executor rereads files instead of repeating the work. The files go at the
    end of the scope of ``temporary`` they are made in, of the scope around it if they ``outlive`` it,
    or else when the session ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.deleteOnExit(where)
    scopes = _scopes()[:-1] if outlive else _scopes()
    if scopes:
        scopes[-1].append(lambda: files.delete(where, True))
    return spark.read.schema(df.schema).parquet(path)


def _scopes() -> list[list[Callable[[], Any]]]:
    return _open.__dict__.setdefault("scopes", [])


@contextmanager
def temporary() -> Iterator[None]:
    """Tables stored inside are deleted at the end, but for those that outlive it."""
    _scopes().append([])
    try:
        yield
    finally:
        for delete in _scopes().pop():
            delete()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def by_bytes(texts: list[str], most: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of ``texts`` with about ``most`` characters each (one text at least)."""
    start = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > most:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


# Before a space or line feed that follows no white space every tokenizer file here cuts anyway: no
# pattern, special token or normaliser of theirs reaches across this place.
_SAFE = re.compile(r"(?<=\S)(?=[ \n])")


def safe_parts(text: str) -> list[str]:
    """``text`` in the shortest parts that can be encoded one by one; a stretch without white space stays whole."""
    return _SAFE.split(text)
