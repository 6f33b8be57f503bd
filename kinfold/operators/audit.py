"""Search, sort and display of audit tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def search(rows: DataFrame, query: str, columns: list[str]) -> DataFrame:
    """Rows with the query, in any case, in one of the columns; blank finds all."""
    if not query.strip():
        return rows
    hits = [F.coalesce(F.contains(F.lower(F.col(c)), F.lower(F.lit(query))), F.lit(False)) for c in columns]
    return rows.filter(reduce(lambda a, b: a | b, hits))


def log_filter(rows: DataFrame, level: str | None = None, query: str = "") -> DataFrame:
    """Log rows of one level (None: all) with the query in message or stage."""
    return search(rows if level is None else rows.filter(F.col("level") == level), query, ["message", "stage"])


def sort(rows: DataFrame, column: str, descending: bool = False, locale: bool = True) -> DataFrame:
    """By one column; strings in the order of the Unicode collation."""
    c = F.col(column)
    if locale and dict(rows.dtypes)[column] == "string":
        c = F.collate(c, "UNICODE")
    return rows.orderBy(c.desc() if descending else c.asc())


def latest(rows: DataFrame, by: str = "timestamp", n: int = 3, ties: tuple[str, ...] = (), each: tuple[str, ...] = ()) -> DataFrame:
    """The latest ``n`` rows, of equal times the first in the order of ``ties``;
    with ``each``, those of every group (only the front of a group is sorted)."""
    order = [F.desc(by), *ties]
    if not each:
        return rows.orderBy(*order).limit(n)
    w = Window.partitionBy(*each).orderBy(*order)
    return rows.withColumn("_place", F.row_number().over(w)).filter(F.col("_place") <= n).drop("_place")


def tier(confidence: Column) -> Column:
    return F.when(confidence >= 0.9, "high").when(confidence >= 0.75, "medium").otherwise("low")


def percent(confidence: Column) -> Column:
    return F.concat(F.floor(confidence * 100 + 0.5).cast("string"), F.lit("%"))


def spaced(c: Column) -> Column:
    """A space behind commas, spaces around bars, single white space."""
    t = F.regexp_replace(F.regexp_replace(c, r",(?=\S)", ", "), r"\s*\|\s*", " | ")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def short(c: Column, limit: int = 28) -> Column:
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit - 3), F.lit("..."))).otherwise(c)


def highlight(c: Column, query: str) -> Column:
    """1-based place of the first hit in any case; 0 if there is none."""
    return F.instr(F.lower(c), F.lower(F.lit(query)))


def end_shown(c: Column) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit("Present"))


def byte_size(n: Column) -> Column:
    return (
        F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < 1024 * 1024, F.format_string("%.1f KB", n / 1024.0))
        .otherwise(F.format_string("%.1f MB", n / (1024.0 * 1024.0)))
    )
