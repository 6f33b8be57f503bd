"""Joins of many rows with one row a key, where a key may be hot."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import settle

SALTS = 16
#: A key is heavy if it holds more than this part of all rows.
HEAVY = 10_000


def salted_join(rows: DataFrame, one: DataFrame, keys: Sequence[str], spread: Sequence[str], how: str = "left", salts: int = SALTS) -> DataFrame:
    """``rows`` with the columns of ``one`` (unique in ``keys``); nulls match.

    ``one`` is repeated ``salts`` times and the rows of a key are dealt over
    the copies by a hash of ``spread``, so a key's rows never meet in one task."""
    left = rows.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    right = one.select(
        *[F.col(k).alias(f"_one_{k}") for k in keys],
        *[c for c in one.columns if c not in keys],
        F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_one_salt"),
    )
    match = F.col("_salt") == F.col("_one_salt")
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_one_{k}"))
    return left.join(right, match, how).drop("_salt", "_one_salt", *[f"_one_{k}" for k in keys])


def heavy_join(rows: DataFrame, one: DataFrame, keys: Sequence[str], weight: str, total: int, how: str = "inner", once: bool = False, least: int = 0) -> DataFrame:
    """``rows`` with the columns of ``one`` (unique in ``keys``, which are not
    null), ``weight`` being how many of the ``total`` rows have the key.

    Keys with more than one in ``HEAVY`` rows, and more than ``least``, are joined
    by broadcast, whatever their size: there are less than ``HEAVY`` of them, as their rows are among
    ``total``.  So no key's rows are sent to one task, and ``one`` is neither
    repeated nor broadcast as a whole.  Both inputs should be settled, as they
    are read twice; with ``once``, the rows are read once and settled with what
    their heavy keys give."""
    names = [c for c in one.columns if c not in keys]
    heavy = (F.col(weight) * HEAVY > F.lit(total)) & (F.col(weight) > least)
    few = one.filter(heavy).select(*[F.col(k).alias(f"_one_{k}") for k in keys], F.struct(*names).alias("_heavy"))
    match = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_one_{k}") for k in keys])
    marked = rows.join(F.broadcast(few), match, "left").drop(*[f"_one_{k}" for k in keys])
    marked = settle(marked, "marked") if once else marked
    hot = marked.filter("_heavy is not null").select(*rows.columns, "_heavy.*")
    rest = marked.filter("_heavy is null").drop("_heavy").join(one.filter(~heavy), list(keys), how)
    return hot.unionByName(rest.select(*hot.columns))
