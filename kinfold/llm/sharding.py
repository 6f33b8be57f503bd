"""Sharding by balanced label propagation.

Documents start with hashed labels and are linked with those of equal text.
Copies of a text with one label are interchangeable, so labels are kept as
(text, shard, how many), and a cut link is a pair of copies with two labels.

A round of Spark joins lets each text's copies move to the label that most of
them have now.  Capacity quotas admit as many moves from one shard to another
as go the opposite way, and beyond that as the target has room; the labels are
then updated.  Rounds end once they no longer lower the number of cut links.
Texts with the share of a quarter of a shard are placed before (there are at
most four a shard), on as few shards as the quotas allow.  In the end unlinked
documents fill what room is left, so that row counts differ by one at most.

The law is ``rows``.  A text is never gathered in one task: positions come from
running totals over hash bins.

Defined results: null text counts as empty and is linked with empty texts;
repeated rows are rows of their own; an empty table gives an empty result;
fewer rows than shards leave the last shards empty; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.operators.prefix import hash_bins, running_totals
from kinfold.operators.salting import heavy_join
from kinfold.operators.scratch import settle

#: Rounds at most, and the part of the cut links that a round must mend for another one.
ROUNDS, WORTH = 12, 0.01


def _lookup(shard: Column, values: list[int]) -> Column:
    """Value of a shard from a list (one entry a shard)."""
    return F.element_at(F.array(*[F.lit(int(v)) for v in values]), shard + 1)


def _load(held: DataFrame, shards: int) -> list[int]:
    """Linked rows of each shard: as many numbers as there are shards."""
    have = {r["shard"]: r["n"] for r in held.groupBy("shard").agg(F.sum("cnt").alias("n")).collect()}
    return [have.get(s, 0) for s in range(shards)]


def cut_links(labels: DataFrame) -> float:
    """Pairs of copies whose labels differ."""
    texts = labels.groupBy("g").agg(F.sum("cnt").cast("double").alias("n"), F.sum(F.col("cnt").cast("double") * F.col("cnt")).alias("q"))
    return texts.agg(F.sum((F.col("n") * F.col("n") - F.col("q")) / 2)).first()[0] or 0.0


def _summed(labels: DataFrame) -> DataFrame:
    return settle(labels.groupBy("g", "shard").agg(F.sum("cnt").alias("cnt")).filter("cnt > 0"), "labels")


def _level(labels: DataFrame, room: list[int]) -> DataFrame:
    """Labels of which no shard has more than its room: the copies beyond it go
    where there is some, in the order of a hash."""
    free = [max(0, r - n) for r, n in zip(room, _load(labels, len(room)), strict=True)]
    rows = running_totals(labels, ["shard"], hash_bins("g"), ["g"], F.col("cnt"))
    stays = F.greatest(F.least("cnt", _lookup(F.col("shard"), room) - F.col("before")), F.lit(0))
    rows = settle(rows.select("g", "shard", "cnt", stays.alias("stays")), "levelled")
    out = running_totals(rows.filter("cnt > stays"), [], hash_bins("g", "shard"), ["g", "shard"], F.col("cnt") - F.col("stays"), "at")
    ends = [sum(free[: s + 1]) for s in range(len(free))]
    spans = [F.struct(F.lit(s).alias("to"), F.lit(e - f).alias("lo"), F.lit(e).alias("hi")) for s, (e, f) in enumerate(zip(ends, free, strict=True)) if f]
    if not spans:
        return labels
    out = out.select("g", "at", (F.col("at") + F.col("cnt") - F.col("stays")).alias("upto"), F.explode(F.array(*spans)).alias("x"))
    part = F.least("upto", "x.hi") - F.greatest("at", "x.lo")
    return _summed(rows.select("g", "shard", F.col("stays").alias("cnt")).unionByName(out.select("g", F.col("x.to").alias("shard"), F.greatest(part, F.lit(0)).alias("cnt"))))


def exchange(flow: dict[tuple[int, int], int], free: list[int]) -> list[int]:
    """How many of the wished moves a quota admits, at shard * shards + target:
    those with a counterpart, then what fits in the target's free rows."""
    n, free = len(free), list(free)
    admitted = [0] * (n * n)
    for (a, b), wished in sorted(flow.items()):
        swap = min(wished, flow.get((b, a), 0))
        more = min(wished - swap, max(0, free[b]))
        free[b] -= more
        admitted[a * n + b] = swap + more
    return admitted


def propagate(labels: DataFrame, room: list[int]) -> DataFrame:
    """Labels (g, shard, cnt) after the rounds; no shard gets above its room."""
    shards, labels = len(room), _level(labels, room)
    cut = cut_links(labels)
    for turn in range(ROUNDS):
        pull = F.struct("cnt", F.xxhash64("g", "shard", F.lit(turn)).alias("tie"), "shard")
        best = labels.groupBy("g").agg(F.max(pull)["shard"].alias("to"), F.count("*").alias("parts")).filter("parts > 1")
        wish = settle(labels.join(best, "g").filter("shard <> to").select("g", "shard", "cnt", "to"), "wishes")  # a row a shard at most
        flow = {(r["shard"], r["to"]): r["n"] for r in wish.groupBy("shard", "to").agg(F.sum("cnt").alias("n")).collect()}
        free = [r - n for r, n in zip(room, _load(labels, shards), strict=True)]
        admitted = exchange(flow, free)
        if not any(admitted):
            break
        rows = running_totals(wish, ["shard", "to"], hash_bins("g"), ["g"], F.col("cnt"))
        given = F.greatest(F.least("cnt", _lookup(F.col("shard") * shards + F.col("to"), admitted) - F.col("before")), F.lit(0))
        moves = settle(rows.select("g", "shard", "to", given.alias("cnt")).filter("cnt > 0"), "moves")
        gone = moves.select("g", "shard", (-F.col("cnt")).alias("cnt"))
        labels = _summed(labels.unionByName(gone).unionByName(moves.select("g", F.col("to").alias("shard"), "cnt")))
        before, cut = cut, cut_links(labels)
        if before - cut <= WORTH * before:
            break
    return labels


def _placed(large: list[tuple[str, int]], room: list[int]) -> list[tuple[str, int, int]]:
    """(g, shard, cnt) of the few large texts, each on the emptiest shards."""
    out = []
    for g, n in sorted(large, key=lambda t: (-t[1], t[0])):
        while n:
            s = max(range(len(room)), key=lambda s: (room[s], -s))
            take = min(n, room[s])
            out.append((g, s, take))
            room[s] -= take
            n -= take
    return out


def shard(docs: DataFrame, shards: int = 24, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size (UTF-8 bytes + 8), text_crc32, law, shard and slot (its
    place in the shard, without gaps) of every row."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = settle(
        docs.select(
            F.col(id).alias("doc_id"),
            (F.octet_length(body) + 8).cast("long").alias("size"),
            F.crc32(body.cast("binary")).alias("text_crc32"),
            F.concat(F.xxhash64(body).cast("string"), F.lit("/"), F.hash(body).cast("string"), F.lit("/"), F.octet_length(body)).alias("g"),
            F.pmod(F.xxhash64(F.lit("shard"), F.col(id)), F.lit(shards)).cast("int").alias("first"),
        ),
        "rows",
    )
    total = rows.count()
    quota = [total // shards + (s < total % shards) for s in range(shards)]
    held = settle(rows.groupBy("g", "first").agg(F.count("*").alias("cnt")), "held")
    linked = held.groupBy("g").agg(F.sum("cnt").alias("n")).filter("n > 1")
    linked = settle(linked, "linked")
    share, room = max(2, total // shards // 4), list(quota)
    large = [(r["g"], r["n"]) for r in linked.filter(F.col("n") > share).collect()]  # 4 a shard at most
    large = rows.sparkSession.createDataFrame(_placed(large, room), "g string, shard int, cnt long")
    small = held.join(linked.filter(F.col("n") <= share).select("g"), "g", "left_semi").select("g", F.col("first").alias("shard"), "cnt")
    small = propagate(settle(small, "labels"), room)
    room = [r - n for r, n in zip(room, _load(small, shards), strict=True)]
    held = small.unionByName(large)
    # each text's copies get a range of positions on each of its shards
    places = Window.partitionBy("g").orderBy("shard")
    held = held.withColumn("upto", F.sum("cnt").over(places)).withColumn("start", F.col("upto") - F.col("cnt"))
    held = settle(held, "held")
    spots = held.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("start", "upto", "shard"))).alias("spots"))  # one entry a shard at most
    spots = settle(spots.join(linked, "g"), "spots")
    rows = settle(heavy_join(rows, spots, ["g"], "n", total, "left").drop("n"), "spotted")
    copies = running_totals(rows.filter("spots is not null"), ["g"], hash_bins("doc_id", "size"), ["doc_id"], F.lit(1), "pos")
    hit = F.filter("spots", lambda x: (x["start"] <= F.col("pos")) & (F.col("pos") < x["upto"]))
    plain = ["doc_id", "size", "text_crc32"]
    copies = copies.select(*plain, F.get(hit, 0)["shard"].alias("shard"))
    single = rows.filter("spots is null").select(*plain, F.lit(None).cast("int").alias("shard"))
    rows = settle(copies.unionByName(single), "placed")
    # the rest fills the room that is left
    ends = [sum(room[: s + 1]) for s in range(shards)]
    free = running_totals(rows.filter("shard is null"), [], hash_bins("doc_id", "size"), ["doc_id"], F.lit(1), "pos")
    fill = reduce(lambda other, s: F.when(F.col("pos") < ends[s], F.lit(s)).otherwise(other), reversed(range(shards)), F.lit(None).cast("int"))
    rows = rows.filter("shard is not null").unionByName(free.withColumn("shard", fill).drop("pos"))
    rows = running_totals(rows, ["shard"], hash_bins("doc_id"), ["doc_id", "text_crc32"], F.lit(1), "slot")
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
