"""Which records are the same entity: shared e-mail addresses or names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.functions.text import strip

from .components import connected_components

EMAIL, NAME = "email", "name"


def keys(records: DataFrame, match_on: tuple[str, ...] = (EMAIL, NAME)) -> DataFrame:
    """(seq, key) for each key of a record; blank values are no keys."""
    parts = []
    if EMAIL in match_on:
        parts.append(F.transform("emails", lambda e: F.concat(F.lit("e:"), F.lower(strip(e)))))
    if NAME in match_on:
        parts.append(F.array(F.concat(F.lit("n:"), F.lower(strip(F.col("full_name"))))))
    made = records.select("seq", F.explode(F.concat(*parts)).alias("key"))
    return made.filter(F.col("key").isNotNull() & (F.length("key") > 2)).distinct()


def hub_links(pairs: DataFrame, node: str = "seq", key: str = "key") -> DataFrame:
    """Links (a, b) from every node of a key to the key's smallest node: as many
    as there are nodes, never all pairs."""
    hubs = pairs.groupBy(key).agg(F.min(node).alias("a"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return pairs.join(hubs, key).select("a", F.col(node).alias("b")).filter("a <> b").distinct()


def entities(records: DataFrame, match_on: tuple[str, ...] = (EMAIL, NAME)) -> DataFrame:
    """``records`` with ``component``: the smallest ``seq`` of its entity."""
    found = connected_components(hub_links(keys(records, match_on)))
    out = records.join(found, F.col("seq") == F.col("node"), "left")
    return out.withColumn("component", F.coalesce("component", "seq")).drop("node")
