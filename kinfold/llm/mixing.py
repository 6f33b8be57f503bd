"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target, and so every document an expected number of copies
(target / source size, times its importance).  The whole part is allocated with
certainty.  The rest p is an inclusion probability: documents are ranked by
their random odds u/(1-u) over their inclusion odds p/(1-p), and the front of
that order is taken up to the source's remaining words (Rosen's Pareto
sampling, with the fixed size counted in words).  The uniform numbers come from
a hash of the id, so reruns agree.

The front is found with running totals over fine bins of the order, so no
source, however hot, is sorted in one task.

Defined results: size is the number of words, 0 for null or blank texts; such
documents get only whole copies (they cost no words and take none); the null
source is a source of its own and comes last; a source of size 0 has target 0;
an empty table gives an empty result.  Rows that share an id share their random
number; they stand side by side in the order and count one by one.  A row with
a null id draws by its text instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.operators.prefix import BINS, ordered_totals, running_totals
from kinfold.operators.salting import salted_join
from kinfold.operators.scratch import settle

#: Fixed value: what counts as a word.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Words of a text: the starts of runs that are not white space."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(id: Column, seed: str) -> Column:
    """A number in (0, 1) with 52 random bits, from a digest of the id."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), id.cast("string"))), 1, 13), 16, 10).cast("double")
    return (bits + F.lit(0.5)) / F.lit(float(1 << 52))


def targets(sizes: DataFrame, total: float, weights: list[float], cap: float) -> DataFrame:
    """Add ``target`` to (source, source_size), one row a source.

    Sources in code-point order, null last, weigh ``weights`` in turn and share
    ``total``; a source stops at ``cap`` times its size and the excess is shared
    again by weight until none is above.  That end point is found in closed
    form: in order of cap / weight, the first k sources stop where the level of
    the others, (total - caps) / weights, is below the next source's own level.
    Sources may be as many as hosts: both orders are totals over ranges."""
    by_name = [F.col("source").isNull(), F.col("source")]
    rows = ordered_totals(sizes.select("source", "source_size"), by_name, {"_n": F.lit(1)})
    weight = F.lit(weights[0])
    for i, w in enumerate(weights[1:], 1):
        weight = F.when(F.col("_n") % len(weights) == i, F.lit(w)).otherwise(weight)
    rows = rows.withColumn("weight", weight.cast("double")).withColumn("_cap", F.lit(float(cap)) * F.col("source_size"))
    rows = rows.withColumn("_own", F.col("_cap") / F.col("weight"))
    rows = settle(ordered_totals(rows, [F.col("_own"), *by_name], {"_caps": F.col("_cap"), "_weights": F.col("weight")}), "levels")
    every = rows.agg(F.sum("weight")).first()[0] or 1.0
    level = (F.lit(total) - F.col("_caps")) / (F.lit(every) - F.col("_weights"))
    open_ = rows.withColumn("_level", level).filter(F.col("_level") * F.col("weight") <= F.col("_cap"))
    final = open_.agg(F.max("_level")).first()[0]  # that of the first open source, as they fall from there on
    target = F.col("_cap") if final is None else F.least(F.col("_cap"), F.lit(final) * F.col("weight"))
    return rows.select("source", "source_size", "weight", target.alias("target"))


def mix(
    docs: DataFrame,
    weights: list[float],
    cap: float = 3.0,
    id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    importance: str | None = None,
    seed: str = "mix",
    keep: list[str] | None = None,
) -> DataFrame:
    """Decide how many copies of each document the mix takes.

    Returns ``keep`` (other columns of ``docs`` to carry) and doc_id, size,
    source_size, target (its source's, in words), copies and taken (= copies x
    size); a kept column named like one of these gives way to it.
    ``importance`` names a non-negative column that tilts the choice
    inside a source; null counts as 0, and a source with no importance at all
    falls back to even shares."""
    tilt = F.coalesce(F.col(importance).cast("double"), F.lit(0.0)) if importance else F.lit(1.0)
    drawn = F.coalesce(F.col(id).cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))))
    rows = docs.select(
        *[F.col(c).alias(f"_keep_{c}") for c in keep or []],
        F.col(id).alias("doc_id"), F.col(source).cast("string").alias("source"),
        word_count(F.col(text)).alias("size"), tilt.alias("_tilt"), uniform(drawn, seed).alias("_u"),
    )
    rows = settle(rows, "sizes")  # the texts are read once
    sizes = settle(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.col("size") * F.col("_tilt")).alias("_tilted")), "sources")
    total = float(sizes.agg(F.sum("source_size")).first()[0] or 0)
    goal = targets(sizes, total, weights, cap)
    goal = goal.join(sizes.select(F.col("source").alias("_s"), "_tilted"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    rows = salted_join(rows, settle(goal, "goal"), ["source"], ["doc_id", "size"])
    tilted = F.when(F.col("_tilted") > 0, F.col("_tilt") / F.col("_tilted")).otherwise(1.0 / F.col("source_size"))
    expected = F.when(F.col("source_size") > 0, F.least(F.col("target") * tilted, F.lit(float(cap)))).otherwise(0.0)
    rows = rows.withColumn("_expected", expected)
    rows = rows.withColumn("_sure", F.floor(F.col("_expected") + 1e-9)).withColumn(
        "_p", F.greatest(F.col("_expected") - F.col("_sure"), F.lit(0.0))
    )
    wanted = rows.groupBy("source").agg(
        F.sum(F.col("_sure") * F.col("size")).alias("_given"), F.avg(F.when(F.col("_p") > 1e-9, F.col("_p"))).alias("_mean")
    )
    rows = salted_join(rows, wanted, ["source"], ["doc_id", "size"])
    # u's odds over p's; times the source's mean odds, which keeps the order and
    # spreads it evenly over (0, 1)
    u = F.col("_u")
    odds = (u / (1 - u)) / (F.col("_p") / (1 - F.col("_p"))) * (F.col("_mean") / (1 - F.col("_mean")))
    rows = rows.withColumn("_q", F.when(F.col("_p") > 1e-9, odds / (1 + odds)))
    rows = settle(rows, "odds")
    fine = F.coalesce(F.col("_q"), F.col("_u")) * (BINS * BINS)
    bins = [F.floor(fine / BINS).cast("long"), F.pmod(F.floor(fine).cast("long"), F.lit(BINS))]
    part = F.when(F.col("_q").isNotNull(), F.col("size")).otherwise(0)
    rows = running_totals(rows, ["source"], bins, [F.col("_q").asc_nulls_last(), "doc_id", "size"], part, "_before")
    room = F.col("target") - F.col("_given")
    # the document across the border is in if that brings the sum nearer
    front = F.col("_q").isNotNull() & (F.col("size") > 0) & (F.col("_before") + F.col("size") / 2 <= room)
    made = ("doc_id", "size", "source_size", "target", "copies", "taken")
    return rows.withColumn("copies", (F.col("_sure") + front.cast("int")).cast("long")).select(
        *[F.col(f"_keep_{c}").alias(c) for c in keep or [] if c.lower() not in made],
        "doc_id",
        "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"),
    )
