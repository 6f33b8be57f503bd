"""Running totals inside keys of any size, without one task per key.

A window over a hot key would put a third of all rows into one task.  Here the
order is given as a list of coarse-to-fine integer bins; totals of the bins are
small aggregates, and only the rows of one finest bin are ever sorted together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import settle

BINS = 1024


def hash_bins(*cols: str, bins: int = BINS) -> list[Column]:
    """Two levels of bins over a hash of ``cols``: ``bins`` x ``bins``."""
    h = F.xxhash64(F.lit("bins"), *[F.col(c) for c in cols])
    return [F.pmod(h, F.lit(bins)), F.pmod(F.shiftright(h, 20), F.lit(bins))]


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    bins: Sequence[Column],
    order: Sequence[str | Column],
    value: Column,
    into: str = "before",
) -> DataFrame:
    """Add ``into``: the sum of ``value`` over the rows of the same key that
    stand before this one in the order (bins, then ``order``).

    ``bins`` may be empty, in which case each key is one window; pass bins
    whenever a key can be large.  Nulls in ``keys`` count as a key of their
    own.  ``order`` must be total inside a bin for reruns to agree.
    """
    names = [f"_b{i}" for i in range(len(bins))]
    rows = df.withColumns(dict(zip(names, bins, strict=True))).withColumn("_v", value.cast("long"))
    leaf = Window.partitionBy(*keys, *names).orderBy(*order)
    out = rows.withColumn(into, F.coalesce(F.sum("_v").over(leaf.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    for depth in range(len(names), 0, -1):
        outer, level = [*keys, *names[: depth - 1]], names[depth - 1]
        sums = rows.groupBy(*outer, level).agg(F.sum("_v").alias("_s"))
        w = Window.partitionBy(*outer).orderBy(level).rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.select(
            *[F.col(c).alias(f"_k_{c}") for c in [*outer, level]],
            F.coalesce(F.sum("_s").over(w), F.lit(0)).alias("_above"),
        )
        match = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in [*outer, level]]
        cond = match[0]
        for m in match[1:]:
            cond = cond & m
        out = out.join(sums, cond, "left").withColumn(into, F.col(into) + F.coalesce("_above", F.lit(0)))
        out = out.drop("_above", *[f"_k_{c}" for c in [*outer, level]])
    return out.drop("_v", *names)


def ordered_totals(df: DataFrame, order: Sequence[Column], values: dict[str, Column]) -> DataFrame:
    """Add, under each name, the sum of a value over the rows that stand before
    this one in a total order, without one task for all rows.

    Rows are dealt by ranges of the order; the totals of the ranges, as many as
    there are shuffle partitions, are the only rows that one task sees whole."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = [f"_v{i}" for i in range(len(values))]
    rows = df.withColumns(dict(zip(names, values.values(), strict=True))).repartitionByRange(parts, *order)
    rows = settle(rows.withColumn("_part", F.spark_partition_id()), "ranges")
    sums = rows.groupBy("_part").agg(*[F.sum(v).alias(v) for v in names])
    above = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("_part").alias("_of"), *[F.sum(v).over(above).alias(f"{v}a") for v in names])
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumns({f"{v}b": F.sum(v).over(inside) for v in names}).join(F.broadcast(sums), F.col("_part") == F.col("_of"))
    both = {n: F.coalesce(f"{v}a", F.lit(0)) + F.coalesce(f"{v}b", F.lit(0)) for n, v in zip(values, names, strict=True)}
    return out.withColumns(both).select(*df.columns, *values)
