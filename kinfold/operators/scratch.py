"""Cutting lineage with tables in the shared scratch folder.

The cluster names the folder in ``spark.checkpoint.dir``.  Where neither that
setting nor the context's checkpoint folder is set, a local master gets a folder
of its own (tests); on a cluster that is an error, since a folder of one machine
would not hold what the others write.  Tables are written as Parquet, so a lost
executor costs a re-read, never a recomputation of an iterative plan.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.errors import ScratchError

_own_folder: str | None = None
_written: list[str] = []  # all that this driver has settled and not deleted
_owned: ContextVar[tuple[list[str], ...]] = ContextVar("owned", default=())  # by the blocks of ``passing`` around


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables."""
    global _own_folder
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):  # local-cluster has executors of its own
        raise ScratchError("spark.checkpoint.dir must name a folder that driver and executors share")
    if _own_folder is None:
        _own_folder = "file://" + tempfile.mkdtemp(prefix="spark-kinfold-")
    return _own_folder


def _at_exit(spark: SparkSession) -> None:
    """A driver that ends leaves no tables, unless its session was stopped before."""
    if spark.sparkContext._jsc is not None:
        clear(spark)


def made(spark: SparkSession, path: str) -> None:
    """Note a folder that this driver has written; the block around owns it."""
    if not _written:
        atexit.unregister(_at_exit)
        atexit.register(_at_exit, spark)
    _written.append(path)
    if _owned.get():
        _owned.get()[-1].append(path)


def settle(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and read it back with its schema."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/kinfold/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    made(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, into: str = "_row", by: Callable[[DataFrame, str], DataFrame] = settle) -> DataFrame:
    """``df``, settled once, with a number of Spark's own for each row: it tells
    rows apart whose ids are null or repeated."""
    return by(df.withColumn(into, F.monotonically_increasing_id()), "numbered")


def rank(id: str, row: str = "_row") -> Column:
    """A key that is never null and orders rows by id, nulls last, then by row."""
    return F.struct(F.col(id).isNull().alias("no_id"), F.col(id).alias("id"), F.col(row).alias("row"))


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder that this library wrote."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


class Passing:
    """Settles what outlives a block; the block around that one owns it."""

    def __init__(self, outer: tuple[list[str], ...]):
        self._outer, self.kept = outer, []

    def __call__(self, df: DataFrame, name: str = "table") -> DataFrame:
        inner = _owned.set(self._outer)
        try:
            out = settle(df, name)
            self.kept.append(_written[-1])
        finally:
            _owned.reset(inner)
        return out


@contextmanager
def passing(spark: SparkSession) -> Iterator[Passing]:
    """A block that owns the tables that are settled inside it: they are deleted at
    its end, but for those settled by what this gives, which must read no others
    afterwards.  Blocks nest, and blocks of other threads own their own tables."""
    outer, mine = _owned.get(), []
    token = _owned.set((*outer, mine))
    try:
        yield Passing(outer)
    finally:
        _owned.reset(token)
        drop(spark, mine)


def drop(spark: SparkSession, tables: list[str]) -> None:
    """Delete settled tables that nothing reads any more."""
    for path in tables:
        if path in _written:
            delete(spark, path)
            _written.remove(path)


def clear(spark: SparkSession) -> None:
    """Delete the tables that this driver has settled, once no DataFrame that
    reads them is needed any more."""
    while _written:
        delete(spark, _written.pop())
