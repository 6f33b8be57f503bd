"""Records that keep arriving: parse and normalise as they come, merge per batch.

Parsing and normalising are stateless and stream as they are.  Merging is not
(two entities may turn out to be one), so the keys of all records and the entity
that each record belongs to are kept as tables.  A micro-batch is joined with the
keys known before; only the entities that it touches are merged anew, and all
others are neither read as records nor written.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kinfold.operators.confidence import active, from_scores
from kinfold.operators.identity import EMAIL, NAME, entities, keys
from kinfold.operators.merge import merged
from kinfold.operators.scratch import exists, settle
from kinfold.plans.pipeline import normalize


class Store:
    """Tables by batch under one folder; a batch that runs again replaces itself."""

    def __init__(self, path: str):
        self.path = path

    def put(self, rows: DataFrame, name: str, batch: int) -> DataFrame:
        where = f"{self.path}/{name}/batch={batch}"
        rows.write.mode("overwrite").parquet(where)
        return rows.sparkSession.read.schema(rows.schema).parquet(where)

    def before(self, like: DataFrame, name: str, batch: int) -> DataFrame:
        """The rows of earlier batches, in the columns of ``like`` and ``batch``."""
        spark, where = like.sparkSession, f"{self.path}/{name}"
        if not exists(spark, where):
            return like.limit(0).withColumn("batch", F.lit(0))
        return spark.read.option("basePath", where).parquet(where).filter(F.col("batch") < batch).select(*like.columns, "batch")


def merge_batch(batch: DataFrame, number: int, store: Store, match_on: tuple[str, ...] = (EMAIL, NAME)) -> tuple[DataFrame, DataFrame]:
    """(profiles of the entities that a batch touches, the components of earlier
    batches in whose place they stand)."""
    new = store.put(normalize(batch), "records", number)
    mine = store.put(keys(new, match_on), "keys", number)
    label = new.select("seq", F.col("seq").alias("component"))
    labels = store.before(label, "labels", number).groupBy("seq").agg(F.max_by("component", "batch").alias("component"))
    hit = store.before(mine, "keys", number).join(mine.select("key").distinct(), "key", "left_semi").select("seq").distinct()
    touched = settle(hit.join(labels, "seq").select("component").distinct(), "touched")
    members = labels.join(touched, "component", "left_semi").select("seq")
    old = store.before(new, "records", number).drop("batch").join(members, "seq", "left_semi")
    found = settle(entities(settle(old.unionByName(new), "affected"), match_on), "entities")
    store.put(found.select("seq", "component"), "labels", number)
    return from_scores(merged(found, scores=tuple(active()))), touched


def merge_stream(
    records: DataFrame,
    store: str,
    checkpoint: str,
    sink: Callable[[DataFrame, int, DataFrame], None],
    match_on: tuple[str, ...] = (EMAIL, NAME),
) -> StreamingQuery:
    """Start a query over a stream of parsed records.

    ``sink(profiles, batch, replaced)`` gets the profiles that a batch changed or
    made, and the components of profiles that these take the place of."""

    def step(batch: DataFrame, number: int) -> None:
        changed, replaced = merge_batch(batch, number, Store(store), match_on)
        sink(changed, number, replaced)

    return records.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).start()


def windowed_counts(events: DataFrame, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts and sums of an event stream by window and type, late rows bounded."""
    if events.isStreaming:  # watermarks need a timestamp with a time zone
        events = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return (
        events
        .groupBy(F.window("ts", width).alias("w"), "event_type")
        .agg(F.count("*").alias("n"), F.sum("value").alias("total"))
        .select(F.col("w.start").alias("start"), "event_type", "n", "total")
    )
