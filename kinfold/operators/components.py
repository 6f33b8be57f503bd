"""Connected components with alternating large-star and small-star rounds.

Kiveris et al., "Connected Components in MapReduce and Beyond" (2014).  Each
round is two aggregations and two joins on the edge table; neighbourhoods are
never gathered into one row or task, and labels never reach the driver (only a
count and a checksum of the edges do, to see that a round changed nothing).  A node
with very many links is joined with its smallest neighbour by broadcast, so its
links stay where they are; the smallest neighbours are combined before they are
shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .salting import heavy_join
from .scratch import passing, settle

MAX_ROUNDS = 60
#: Links of a node that one task joins without more ado.
MANY = 1_000


def _with_low(edges: DataFrame, total: int) -> DataFrame:
    """Edges (u, v) with ``low``, the smallest neighbour of u."""
    low = edges.groupBy("u").agg(F.min("v").alias("low"), F.count("*").alias("_links"))
    return heavy_join(edges, low, ["u"], "_links", total, least=MANY).drop("_links")


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    out = _with_low(both, 2 * total).filter("v > u").select(F.col("v").alias("u"), F.least("u", "low").alias("v"))
    return out.filter("u <> v").distinct()


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    """Edges come with u > v."""
    near = _with_low(edges, total)
    moved = near.filter("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return moved.unionByName(near.select("u", F.col("low").alias("v"))).distinct()


def _print_of(edges: DataFrame) -> tuple:
    """Size and checksum, from one pass over the written table."""
    row = edges.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31)))).first()
    return (row[0], row[1])


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node that has a link; component = smallest
    node reachable.  Nodes are bigint.  Self-links are ignored, repeated links
    count once, rows with a null end are ignored, an empty input gives an empty
    result."""
    edges = (
        links.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v"))
        .filter(F.col(a).isNotNull() & F.col(b).isNotNull())
        .filter("u > v")
        .distinct()
    )
    with passing(edges.sparkSession) as keep:  # a round's edges go with it
        edges = settle(edges, "edges")
        seen = _print_of(edges)
        for _ in range(MAX_ROUNDS):
            edges = settle(_large_star(edges, seen[0]), "edges")
            edges = settle(_small_star(edges, seen[0]), "edges")
            now = _print_of(edges)
            if now == seen:
                own = edges.select(F.col("v").alias("node"), F.col("v").alias("component"))
                return keep(edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(own).distinct(), "components")
            seen = now
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
