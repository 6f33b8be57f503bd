"""Approximate nearest neighbours by a permutation index.

A vector is represented by its ``near`` nearest pivots in order.  Each index
block keeps pivot inverted files: for a pivot, the vectors of the block that
have it among their nearest, and at which place.  A query walks the files of
its own nearest pivots, which gives the footrule distance of its order to that
of every vector of the block (with absent pivots at place ``near``), takes the
front of each block by that distance and reranks it exactly.

The front is the block's part of ``depth * n ** GROWTH`` rows for a table of n,
with three standard deviations of what a random block may hold above its part:
the more vectors there are, the nearer the nearest of them lie, and the smaller
the part of the table among which they stand (6.6 % of 10,256 and 3.5 % of 51,282
random directions in 64 dimensions hold 90 % of the 20 nearest; the law takes
two thirds more than that).  So reranking grows with n ** GROWTH a query; the
walk over the files of all blocks stays in proportion to n.

Queries are packed into blocks as well; every query block meets every index
block by an equi-join on the block number, so tasks hold one pair of blocks
and memory does not depend on the table.  The pivots are the only fitted part:
a sample of at most ``pivots`` vectors, picked by a hash of the id.

Defined results: vectors that are null, zero, of another length than most, or
hold null or non-finite components take no part, neither as queries nor as candidates;
repeated vectors are candidates each, ties go to the smaller id; fewer than
``k`` candidates give fewer rows; an empty table gives an empty result; rows
that share an id are all candidates, but none for a query of that id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.operators.scratch import settle

PIVOTS = 256
NEAR = 64  # at most 255
#: Rows reranked for a query: DEPTH * n ** GROWTH.
DEPTH, GROWTH = 4.5, 0.6
#: Rows of an index block and of a query block.
BLOCK = 4096
QUERY_BLOCK = 512


def usable(vectors: DataFrame, id: str, vector: str) -> DataFrame:
    """(vec_id, v) of the vectors that take part."""
    v = F.col(vector).cast("array<double>")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(id).cast("long").alias("vec_id"), v.alias("v"))
    return rows.filter(F.col("v").isNotNull() & F.col("vec_id").isNotNull() & ~bad & F.exists("v", lambda x: x != 0))


def _places(x: np.ndarray, pivots: np.ndarray, near: int) -> np.ndarray:
    """Each row's nearest pivots, nearest first."""
    return np.argsort(-(x @ pivots.T), axis=1, kind="stable")[:, :near]


def _pack(rows: DataFrame, size: int, parts: int) -> DataFrame:
    """Rows gathered into blocks: (part, ids, data), doubles row by row, sorted
    by id.  Every one of the ``parts`` has one block, or more if it is large."""

    def block(part, held):
        i, x = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.argsort(i, kind="stable")
        return pd.DataFrame({"part": [part], "ids": [i[order].tobytes()], "data": [x[order].tobytes()]})

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            for part, own in batch.groupby("part"):
                for lo in range(0, len(own), size):
                    cut = own.iloc[lo : lo + size]
                    rows = held.setdefault(part, [])
                    rows.append((cut["vec_id"].to_numpy("i8"), np.stack(cut["v"].to_numpy()).astype("f8")))
                    if sum(len(i) for i, _ in rows) >= 2 * size:
                        yield block(part, held.pop(part))
        for part, rows in held.items():
            yield block(part, rows)

    part = F.pmod(F.xxhash64(F.lit("part"), "vec_id"), F.lit(parts)).cast("int")
    return rows.withColumn("part", part).repartition(parts, "part").mapInPandas(pack, "part int, ids binary, data binary")


def front_of(size: int, n: int, depth: float = DEPTH, k: int = 0) -> int:
    """Rows that a block of ``size`` reranks, of a table of n."""
    mean = depth * n**GROWTH * size / n
    return max(k, int(np.ceil(mean + 3 * mean**0.5)))


def _search_block(ids, x, files, q_ids, q, q_places, near, k, count):
    """Rows (query, candidate, score) of one index block for one query block.

    ``files``: vectors by pivot, ``count`` of them are reranked."""
    starts, members, places = files
    n, out = len(ids), []
    # the block's files side by side: how near the front a pivot stands, 0 if absent
    table = np.zeros((len(starts) - 1, n), "u1")
    table[np.repeat(np.arange(len(starts) - 1), np.diff(starts)), members] = near - places
    at, caps = np.arange(n, dtype="i4"), (near - np.arange(near)).astype("u1")[:, None]
    for i in range(len(q_ids)):
        # a constant less half the footrule distance
        gain = np.minimum(table[q_places[i]], caps).sum(axis=0, dtype="u2")
        order = at - gain.astype("i4") * np.int32(n)  # no two are equal: of equal gains the smaller id is first
        front = np.sort(np.argpartition(order, count)[: count + 1]) if count + 1 < n else at
        front = front[ids[front] != q_ids[i]]
        score = (x[front] * q[i]).sum(axis=1)
        if len(front) > k:  # all that are as good as the k-th
            chosen = np.flatnonzero(score >= np.partition(score, -k)[-k])
            front, score = front[chosen], score[chosen]
        best = np.argsort(-score, kind="stable")[:k]  # the front is in order of ids
        out.append((np.full(len(best), q_ids[i]), ids[front[best]], score[best]))
    return [np.concatenate(c) for c in zip(*out, strict=True)]


def search(
    vectors: DataFrame,
    is_query: Column,
    k: int = 20,
    id: str = "vec_id",
    vector: str = "embedding",
    pivots: int = PIVOTS,
    near: int = NEAR,
    depth: float = DEPTH,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows with the largest inner
    product found for each query, best first.  ``is_query`` tests ``vec_id``."""
    spark = vectors.sparkSession
    rows = usable(vectors, id, vector)
    width = rows.groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), "w").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if width is None:
        return spark.createDataFrame([], schema)
    rows = rows.filter(F.size("v") == width["w"])
    n, dims = width["count"], width["w"]
    sample = rows.orderBy(F.xxhash64(F.lit("pivot"), "vec_id"), "vec_id").limit(pivots).collect()
    chosen = spark.sparkContext.broadcast(np.array([r["v"] for r in sample]))
    near = min(near, len(sample))

    def post(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = []
            for data in batch["data"]:
                order = _places(np.frombuffer(data).reshape(-1, dims), chosen.value, near)
                pivot = order.ravel()
                by = np.argsort(pivot, kind="stable")
                starts = np.searchsorted(pivot[by], np.arange(len(chosen.value) + 1)).astype("i4")
                member, place = np.divmod(by, near)
                made.append((starts.tobytes(), member.astype("i4").tobytes(), place.astype("i4").tobytes()))
            yield pd.concat(
                [batch.reset_index(drop=True), pd.DataFrame(made, columns=["starts", "members", "places"])], axis=1
            )

    fields = "part int, ids binary, data binary, starts binary, members binary, places binary"
    parts = -(-n // BLOCK)
    index = settle(_pack(rows, BLOCK, parts).mapInPandas(post, fields), "index")
    asked = rows.filter(is_query)
    queries = settle(_pack(asked, QUERY_BLOCK, max(1, -(-n // (20 * QUERY_BLOCK)))), "queries")
    every = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    pairs = queries.select(F.col("ids").alias("q_ids"), F.col("data").alias("q_data"), every.alias("part"))

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                ids, q_ids = np.frombuffer(r.ids, "i8"), np.frombuffer(r.q_ids, "i8")
                x, q = (np.frombuffer(d).reshape(-1, dims) for d in (r.data, r.q_data))
                files = [np.frombuffer(f, "i4") for f in (r.starts, r.members, r.places)]
                count = front_of(len(ids), n, depth, k)
                found = _search_block(ids, x, files, q_ids, q, _places(q, chosen.value, near), near, k, count)
                yield pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), found, strict=True)))

    found = pairs.join(index, "part").mapInPandas(look, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    )
