"""Skill names as Column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.constants import FUZZY_SKILL_RATIO, SKILL_ALIASES

from .text import clean, distinct_by, once


def alias_map(aliases: dict[str, str]) -> Column:
    return F.create_map(*map(F.lit, chain.from_iterable(aliases.items())))


def canonicalize_skill(c: Column, aliases: dict[str, str] = SKILL_ALIASES) -> Column:
    """Canonical name of a known alias, else the stripped text; blank gives null."""

    def named(s: Column) -> Column:
        known = F.lower(s).isin(*aliases)  # one look into a hash set; the map is read from its front
        return F.coalesce(F.when(known, F.try_element_at(alias_map(aliases), F.lower(s))), s)

    return once(clean(c), named)


#: Letters of a name that fit the bits of a long, one of which stays free.
WORD = 62


def _letters(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda x: x != "")


def common_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence, bit-parallel: a cell of the table
    is a bit of a word, and a letter of ``b`` moves the words of ``a`` on by one
    addition each.  The bits of a word that are 0 at the end are the length."""
    n = F.length(a)
    shift = lambda x, by: F.call_function("shiftleft", x, by)
    one = F.lit(1).cast("long")

    def word(start: Column) -> Column:
        """(letters of a from start on, at most WORD)"""
        return _letters(F.substring(a, start, F.lit(WORD)))

    def step(state: Column, letter: Column) -> Column:
        # words from the first on, with the carry of the addition in ``carry``
        def moved(done: Column, w: Column) -> Column:
            hits = F.aggregate(F.transform(w["letters"], lambda x, i: F.when(x == letter, shift(one, i)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda s, x: s + x)

            def added(h: Column) -> Column:
                s, u = w["bits"], w["bits"].bitwiseAND(h)
                total = s + u + done["carry"]
                bits = total.bitwiseOR(s - u).bitwiseAND(w["full"])
                carry = F.when(total > w["full"], one).otherwise(F.lit(0).cast("long"))
                return F.struct(F.array_append(done["words"], F.struct(w["letters"].alias("letters"), w["full"].alias("full"), bits.alias("bits"))).alias("words"), carry.alias("carry"))

            return F.element_at(F.transform(F.array(hits), added), 1)  # hits are found once

        empty = F.struct(F.filter(state, lambda w: F.lit(False)).alias("words"), F.lit(0).cast("long").alias("carry"))
        return F.aggregate(state, empty, moved, lambda done: done["words"])

    starts = F.sequence(F.lit(1), F.greatest(n, F.lit(1)), F.lit(WORD))
    full = lambda start: shift(one, F.least(F.lit(WORD), n - start + 1)) - 1
    state = F.transform(starts, lambda start: F.struct(word(start).alias("letters"), full(start).alias("full"), full(start).alias("bits")))
    end = F.aggregate(_letters(b), state, step)
    return (n - F.aggregate(end, F.lit(0), lambda count, w: count + F.bit_count(w["bits"]))).cast("int")


def similarity(a: Column, b: Column) -> Column:
    """0 to 100: twice the common length over both lengths."""
    total = F.length(a) + F.length(b)
    return F.when(total > 0, 200.0 * common_length(a, b) / total).otherwise(100.0)


def without_near(items: Column, ratio: float = FUZZY_SKILL_RATIO) -> Column:
    """Drop items that are nearly one kept before them (compared in lower case)."""

    def add(kept: Column, x: Column) -> Column:
        # no edit distance is above the insertions and deletions that the ratio allows, which spares most tables
        def near(k: Column) -> Column:
            allowed = (F.length(k) + F.length(x)) * (100.0 - ratio) / 100.0 + 1e-9
            return (F.levenshtein(F.lower(k), F.lower(x)) <= allowed) & (similarity(F.lower(x), F.lower(k)) >= ratio)

        return F.when(F.exists(kept, near), kept).otherwise(F.array_append(kept, x))

    return F.aggregate(items, F.array().cast("array<string>"), add)


def canonicalize_skills(items: Column, fuzzy: bool = True) -> Column:
    """Canonical names without repeats, in order; then without near repeats."""
    names = F.filter(F.transform(items, lambda x: canonicalize_skill(x)), lambda x: x.isNotNull())
    names = distinct_by(names, F.lower)
    return without_near(names) if fuzzy else names


def canonical_rows(rows: DataFrame, by: str, order: Column, name: Column, aliases: dict[str, str] = SKILL_ALIASES) -> DataFrame:
    """(by, skills): what ``canonicalize_skills`` without near repeats gives for
    each group's names in an order, from rows instead of arrays.  The aliases, a
    bounded list, are broadcast; names are combined before they are shuffled and
    only a group's distinct names are ever gathered."""
    table = rows.sparkSession.createDataFrame(list(aliases.items()), "_alias string, _canonical string")
    plain = rows.select(by, order.alias("_o"), clean(name).alias("_name")).filter("_name is not null")
    named = plain.join(F.broadcast(table), F.lower("_name") == F.col("_alias"), "left")
    named = named.select(by, "_o", F.coalesce("_canonical", "_name").alias("_name"))
    one = named.groupBy(by, F.lower("_name").alias("_k")).agg(F.min(F.struct("_o", "_name")).alias("x"))
    skills = F.transform(F.array_sort(F.collect_list("x")), lambda x: x["_name"])
    return one.groupBy(by).agg(skills.alias("skills"))
