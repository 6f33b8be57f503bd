"""Counters of a run, gathered while its stages run, and a table of them."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

LOG = "timestamp timestamp, level string, stage string, message string"


class RunLog:
    """Observed stages; nothing is computed for the log alone."""

    def __init__(self) -> None:
        self._seen: list[tuple[str, Observation]] = []

    def watch(self, rows: DataFrame, stage: str, **counters: Column) -> DataFrame:
        """``rows``, with their number and the given aggregates observed."""
        seen = Observation(f"{stage}-{len(self._seen)}")
        self._seen.append((stage, seen))
        return rows.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in counters.items()])

    def table(self, spark: SparkSession) -> DataFrame:
        """(timestamp, level, stage, message) of the stages whose action has run."""
        now, lines = datetime.now(timezone.utc), []
        for stage, seen in self._seen:
            values = seen.get
            level = "INFO" if values.get("rows") else "WARN"
            lines.append((now, level, stage, ", ".join(f"{n}={v}" for n, v in values.items())))
        return spark.createDataFrame(lines, LOG)
