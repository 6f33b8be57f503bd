"""Kinds of sources, and the readers registered for them."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.constants import EXTENSIONS
from kinfold.errors import SourceError
from kinfold.operators.prefix import ordered_totals
from kinfold.operators.scratch import settle

Reader = Callable[[SparkSession, list[tuple[int, str]]], DataFrame]
_readers: dict[str, Reader] = {}


def register(kind: str, reader: Reader) -> None:
    """Use ``reader(spark, [(file index, path)])`` for sources of that kind."""
    if not callable(reader):
        raise TypeError(f"the reader of {kind} cannot be called")
    _readers[kind] = reader


def reader_of(kind: str) -> Reader:
    if kind not in _readers:
        raise KeyError(f"no reader for {kind}; known are {', '.join(kinds())}")
    return _readers[kind]


def kinds() -> list[str]:
    return sorted(_readers)


def kind_of(path: str) -> str:
    """Kind of a source by its file extension."""
    kind = EXTENSIONS.get(os.path.splitext(path)[1].lower())
    if kind is None:
        raise SourceError(f"unknown kind of source: {path}")
    return kind


def kind_column(path: Column) -> Column:
    """As ``kind_of``, for a column of paths; unknown kinds are null."""
    suffix = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    out = F.lit(None).cast("string")
    for ext, kind in EXTENSIONS.items():
        out = F.when(suffix == ext, F.lit(kind)).otherwise(out)
    return out


def manifest(paths: Iterable[str]) -> dict[str, list[tuple[int, str]]]:
    """Kind -> [(index, path)] in the order given."""
    found: dict[str, list[tuple[int, str]]] = {}
    for i, p in enumerate(map(str, paths)):
        found.setdefault(kind_of(p), []).append((i, p))
    return found


def file_column(path: Column) -> Column:
    """A file's path as ``files_table`` writes it: without scheme, not URL-coded."""
    return F.regexp_replace(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), r"^[a-z0-9]+:/*", "/")


def files_table(spark: SparkSession, files: list[tuple[int, str]], more: str = "", values: dict[int, tuple] | None = None) -> DataFrame:
    """(_path, _number) of the files, and further columns ``more`` (DDL) with
    their ``values`` by number: a table to join with the rows of the files."""
    bare = lambda p: "/" + p.split("://")[-1].lstrip("/") if "://" in p else os.path.abspath(p)
    rows = [(bare(p), i, *((values or {}).get(i, ()))) for i, p in files]
    return spark.createDataFrame(rows, "_path string, _number long" + (f", {more}" if more else ""))


#: Bits of ``seq`` below the number of the file: bytes, so also rows, of one file.
ROWS = 40


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length, kind, number) of all files below a folder, listed by Spark and
    numbered in order of their paths; settled.  ``kind`` is null where it is unknown."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")  # contents are not read
    files = files.select(file_column(F.col("path")).alias("path"), "length").withColumn("kind", kind_column(F.col("path")))
    return settle(ordered_totals(files, [F.col("path")], {"number": F.lit(1)}), "listing")
