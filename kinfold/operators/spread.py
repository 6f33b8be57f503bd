"""Enough partitions for work on long texts."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt over all cores if its files make fewer partitions than that.

    A small table is often one row group and so one task.  Tables with at least
    a partition a core are left as they are, so large ones are never shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
