"""Cut a plan by writing it to the shared folder of the cluster.

A written table survives lost executors, keeps its partition numbers fixed and
can be read back column by column, which an RDD checkpoint cannot.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
#: With it a query deletes its shuffle files when it ends; else they stay until the driver collects its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Paths written inside the innermost ``settle``.
_STEPS: ContextVar[list[str] | None] = ContextVar("steps", default=None)

#: Where tables are that ``materialize`` returned and nothing has released.
_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_folder(spark: SparkSession) -> str:
    """The folder named by the session; a fresh one only where none is named."""
    named = spark.conf.get(_SETTING, None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {_SETTING} to a folder that all executors can reach")
    fresh = tempfile.mkdtemp(prefix="plumbline-")
    spark.conf.set(_SETTING, fresh)
    return fresh


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


@contextmanager
def _cleaning(spark: SparkSession) -> Iterator[None]:
    """What is written inside leaves no shuffle files behind."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def materialize(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` once and return a scan of the written copy."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    with _cleaning(spark):
        df.write.parquet(path)
    if (steps := _STEPS.get()) is not None:
        steps.append(path)
    found = spark.read.schema(df.schema).parquet(path)
    _PATHS[found] = path
    return found


def discard(spark: SparkSession, path: str) -> None:
    """Delete a written table that no plan will read again."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def release(table: DataFrame) -> None:
    """Delete what ``materialize`` wrote for ``table``; no plan may read it again."""
    discard(table.sparkSession, _PATHS.pop(table))


def settle(spark: SparkSession, build: Callable[[], DataFrame], label: str = "table") -> DataFrame:
    """Write what ``build`` returns, then delete the tables that it wrote on the way; no other plan may read those."""
    outer = _STEPS.set([])
    try:
        result = materialize(build(), label)
        *steps, path = _STEPS.get()
    finally:
        _STEPS.reset(outer)
    for step in steps:
        discard(spark, step)
    if (around := _STEPS.get()) is not None:
        around.append(path)
    return result
