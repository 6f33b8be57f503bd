"""Near repeats of names inside groups, from rows instead of arrays.

A name goes if it is nearly equal to one that its group keeps before it.  Pairs of
distinct names are found and compared once for the whole table, whatever the number
of rows and groups they stand in:

1. A set-similarity join over bigrams: names whose common subsequence reaches the
   ratio are at most so many insertions and deletions apart, each of which touches
   two bigrams, so both have one of their few rarest bigrams in common (a prefix
   filter, with a filter by length).
2. The pairs are compared by a bit-parallel longest common subsequence.
3. Names that near ones connect are a class.  A name of a class of up to 64 knows its
   near ones as the bits of a long, so a group's names of a class, 64 at most once
   repeats are gone, are decided by a fold over them in order.
4. Names of larger classes are linked with the near ones that their group has, and
   the links are decided in order: a name without an undecided earlier link is kept,
   what links to a kept earlier one goes.  A round decides all such names of all
   groups at once.  A group's links come from its pairs in a class or from the names
   near its own, whichever are fewer.

No group is gathered but for ``kept_groups``, whose rows are groups, and which combines
the names of heavy groups first.  Defined results: null names count for nothing; names
equal but for case are one, the first of them; rows of equal order are taken by
name; a null group is a group of its own; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.constants import FUZZY_SKILL_RATIO
from kinfold.functions.skills import similarity

from .components import connected_components
from .salting import HEAVY, heavy_join
from .scratch import settle

MAX_ROUNDS = 1000
#: Names of a class whose near ones are the bits of a long.
BITS = 64
#: Rows of a group that one task takes without more ado.
LEAST = 1_000
#: Items of the sketch that finds heavy groups: its error is below a third of a heavy group's part.
TRACKED = 1 << 16


def _apart(length: Column, ratio: float) -> Column:
    """Most insertions and deletions between two names of this length in all."""
    return F.floor(length * (100.0 - ratio) / 100.0 + 1e-9).cast("int")


def _longest(length: Column, ratio: float) -> Column:
    """Length of the longest name that may be near one of this length."""
    return F.floor(length * (200.0 - ratio) / ratio + 1e-9).cast("int")


def bigrams(name: Column) -> Column:
    """The bigrams of a name; those that repeat are numbered."""
    n = F.length(name)
    pairs = F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substring(name, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    before = lambda x, i: F.size(F.filter(F.slice(pairs, 1, i), lambda y: y == x))
    return F.transform(pairs, lambda x, i: F.concat(x, before(x, i).cast("string")))


def near_pairs(names: DataFrame, ratio: float = FUZZY_SKILL_RATIO) -> DataFrame:
    """(a, b) of the ids of distinct ``names`` (id, name) with at least ``ratio``;
    a < b.  Names whose every bigram may be touched have one more in common."""
    own = settle(names.select("id", "name", F.length("name").alias("n")), "names")
    most = _apart(F.col("n") + _longest(F.col("n"), ratio), ratio)
    short = F.col("n") - 1 <= 2 * most
    grams = own.withColumn("most", most).select("id", "n", "most", F.explode(bigrams(F.col("name"))).alias("gram"))
    grams = settle(grams, "grams")
    sizes = settle(grams.groupBy("gram").agg(F.count("*").alias("c")), "gram-sizes")
    ranked = heavy_join(grams, sizes.withColumn("often", F.col("c")), ["gram"], "c", grams.count())
    first = ranked.groupBy("id", "n", "most").agg(F.array_sort(F.collect_list(F.struct("often", "gram"))).alias("g"))
    prefix = first.select("id", "n", F.explode(F.slice("g", 1, 2 * F.col("most") + 1)["gram"]).alias("gram"))
    # a name may be as short as its partner is long: both sides of a short one share the empty bigram
    reach = _longest(F.lit(own.filter(short).agg(F.max("n")).first()[0] or 0), ratio)
    prefix = settle(prefix.unionByName(own.filter(F.col("n") <= reach).select("id", "n", F.lit("").alias("gram"))), "prefixes")
    other = prefix.select(F.col("id").alias("b"), F.col("n").alias("n2"), "gram")
    apart = F.abs(F.col("n") - F.col("n2")) <= _apart(F.col("n") + F.col("n2"), ratio)
    pairs = prefix.join(other, "gram").filter((F.col("id") < F.col("b")) & apart).select(F.col("id").alias("a"), "b").distinct()
    text = lambda side: own.select(F.col("id").alias(side), F.col("name").alias(f"{side}_name"))
    both = pairs.join(text("a"), "a").join(text("b"), "b")
    a, b = F.col("a_name"), F.col("b_name")
    # no edit distance is above the insertions and deletions, and it is cheap
    both = both.filter(F.levenshtein(a, b) <= _apart(F.length(a) + F.length(b), ratio))
    return both.filter(similarity(a, b) >= ratio).select("a", "b")


def _decided(links: DataFrame) -> DataFrame:
    """(node) of the names that go, from links (first, then) in the order of
    their groups: all that link to one that stays before them."""
    gone = []
    links = settle(links, "name-links")
    for _ in range(MAX_ROUNDS):
        if links.isEmpty():
            break
        kept = links.select("first").distinct().join(links.select(F.col("then").alias("first")), "first", "left_anti")
        out = settle(links.join(kept, "first", "left_semi").select(F.col("then").alias("node")).distinct(), "names-gone")
        gone.append(out)
        links = links.join(out, F.col("then") == F.col("node"), "left_anti").join(out, F.col("first") == F.col("node"), "left_anti")
        links = settle(links, "name-links")
    else:
        raise RuntimeError(f"names were not decided in {MAX_ROUNDS} rounds")
    done = links.select(F.col("then").alias("node")).limit(0)
    for out in gone:
        done = done.unionByName(out)
    return done


def classed(rows: DataFrame, name: str, ratio: float = FUZZY_SKILL_RATIO) -> tuple[DataFrame, DataFrame, bool]:
    """(rows, near, large): the rows that have a name with its ``id``, its class ``cls``
    and, in a class of up to ``BITS`` names, its own bit and those of the ``near`` ones
    (else null); (a, b) of near names in both orders; whether a class is larger."""
    named = settle(rows.filter(F.col(name).isNotNull()).withColumn("_key", F.lower(name)), "named")
    known = settle(named.groupBy(F.col("_key").alias("name")).agg(F.count("*").alias("c")).withColumn("id", F.monotonically_increasing_id()), "distinct-names")
    pairs = settle(near_pairs(known, ratio), "near-names")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    found = connected_components(pairs)
    sizes = settle(found.groupBy("component").agg(F.count("*").alias("n")), "class-sizes")
    placed = settle(heavy_join(found, sizes, ["component"], "n", found.count()), "classes")
    bit = F.row_number().over(Window.partitionBy("component").orderBy("node")) - 1
    small = settle(placed.filter(F.col("n") <= BITS).select("node", F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("own")), "class-bits")
    masks = both.join(small.select(F.col("node").alias("b"), "own"), "b").groupBy(F.col("a").alias("node")).agg(F.bit_or("own").alias("mask"))
    bits = placed.select("node", "component").join(small, "node", "left").join(masks, "node", "left")
    alone = F.col("node").isNull()  # no name is near
    one = known.join(bits, F.col("id") == F.col("node"), "left").select(
        F.col("name").alias("_key"), "id", "c", F.coalesce("component", "id").alias("cls"), F.when(alone, F.lit(1).cast("long")).otherwise(F.col("own")).alias("own"),
        F.when(alone, F.lit(0).cast("long")).otherwise(F.col("mask")).alias("mask"),
    )
    out = heavy_join(named, settle(one, "classed-names"), ["_key"], "c", named.count()).drop("_key", "c")
    return settle(out, "classed"), both, not sizes.filter(F.col("n") > BITS).isEmpty()


def _first_ones(names: Column) -> Column:
    """The ``x`` of those of one class (x, own, mask) that stay, in order of x."""

    def add(s: Column, e: Column) -> Column:
        more = F.struct(s["bits"].bitwiseOR(e["own"]).alias("bits"), F.array_append(s["kept"], e["x"]).alias("kept"))
        return F.when(s["bits"].bitwiseAND(e["own"].bitwiseOR(e["mask"])) == 0, more).otherwise(s)

    every = F.transform(names, lambda e: e["x"])
    none = F.struct(F.lit(0).cast("long").alias("bits"), F.slice(every, 1, 0).alias("kept"))
    return F.when(F.size(names) == 1, every).otherwise(F.aggregate(F.array_sort(names), none, add, lambda s: s["kept"]))


def _folded(rows: DataFrame, by: str) -> DataFrame:
    """(by, n, kept): for each class of up to ``BITS`` names of a group, its rows and
    what stays of them.  ``rows`` (by, x, n, own, mask, cls) may be one a name."""
    names = F.collect_list(F.struct("x", "own", "mask"))
    return rows.groupBy(by, "cls").agg(names.alias("names"), F.sum("n").alias("n")).select(by, "n", _first_ones(F.col("names")).alias("kept"))


def _combined(rows: DataFrame, by: str) -> DataFrame:
    """A row for each name of a group, combined before it is shuffled."""
    return rows.groupBy(by, "cls", "own", "mask").agg(F.min("x").alias("x"), F.sum("n").alias("n"))


def _linked(rows: DataFrame, by: str, near: DataFrame) -> DataFrame:
    """(by, x) of what stays of the names of larger classes."""
    one = rows.groupBy(by, "cls", "id").agg(F.min("x").alias("x")).withColumn("_by", F.struct(by)).withColumn("node", F.monotonically_increasing_id())
    one = settle(one.join(near.groupBy(F.col("a").alias("id")).agg(F.count("*").alias("links")), "id"), "group-names")
    sizes = settle(one.groupBy("_by", "cls").agg(F.count("*").alias("m"), F.sum("links").alias("sum")).filter("m > 1"), "group-classes")
    own = settle(heavy_join(one, sizes, ["_by", "cls"], "m", one.count()), "crowded-names")
    other = own.select("_by", "cls", F.col("id").alias("b"), F.col("x").alias("_x"), F.col("node").alias("then"))
    after, few = F.col("x") < F.col("_x"), F.col("m") * F.col("m") <= F.col("sum")
    paired = own.filter(few).join(other, ["_by", "cls"]).filter(after).select(F.col("id").alias("a"), "b", F.col("node").alias("first"), "then")
    wanted = own.filter(~few).join(near, F.col("id") == F.col("a")).select("_by", "cls", "b", "x", F.col("node").alias("first"))
    met = paired.join(near, ["a", "b"]).select("first", "then").unionByName(wanted.join(other, ["_by", "cls", "b"]).filter(after).select("first", "then"))
    return one.join(_decided(met), "node", "left_anti").select(by, "x")


def _with_x(rows: DataFrame, by: str, order: str, name: str) -> DataFrame:
    return rows.select(by, F.struct(F.col(order).alias("o"), F.col(name).alias("name")).alias("x"), F.lit(1).cast("long").alias("n"), "id", "cls", "own", "mask")


def _stay(rows: DataFrame, by: str, near: DataFrame, large: bool) -> DataFrame:
    """(by, x) of all that stay."""
    small = _folded(_combined(rows.filter("own is not null"), by), by).select(by, F.explode("kept").alias("x"))
    return small.unionByName(_linked(rows.filter("own is null"), by, near)) if large else small


def without_near_rows(rows: DataFrame, by: str, order: str, name: str, ratio: float = FUZZY_SKILL_RATIO) -> DataFrame:
    """The rows (by, order, name) that stay, in the order of ``order`` and name."""
    found, near, large = classed(rows.select(by, order, name), name, ratio)
    return _stay(_with_x(found, by, order, name), by, near, large).select(by, F.col("x.o").alias(order), F.col("x.name").alias(name))


def heavy_groups(rows: DataFrame, by: str) -> list[int]:
    """Hashes of the groups with more than one in ``HEAVY`` rows, from a sketch in one
    pass: what it names decides where rows are combined, not what stays."""
    seen = rows.agg(F.count("*").alias("n"), F.call_function("approx_top_k", F.xxhash64(by), F.lit(HEAVY), F.lit(TRACKED)).alias("top")).first()
    return [x["item"] for x in seen["top"] or () if x["count"] > LEAST and x["count"] * HEAVY > seen["n"]]


def kept_groups(rows: DataFrame, by: str, order: str, name: str, near: DataFrame, large: bool, heavy: list[int]) -> DataFrame:
    """(by, n, kept): a group's rows, and the (o, name) of those that stay, in order.
    ``rows`` (by, order, name) have what ``classed`` adds; they are sorted by name
    before the only shuffle, in which equal names then take little."""
    rows = _with_x(rows, by, order, name)

    def gathered(folded: DataFrame) -> DataFrame:
        return folded.groupBy(by).agg(F.sum("n").alias("n"), F.array_sort(F.flatten(F.collect_list("kept"))).alias("kept"))

    if large:
        counts = rows.groupBy(by).agg(F.sum("n").alias("n")).select(by, "n", F.array().cast(f"array<{rows.schema['x'].dataType.simpleString()}>").alias("kept"))
        stay = _stay(settle(rows, "classed-rows"), by, near, large).select(by, F.lit(0).cast("long").alias("n"), F.array("x").alias("kept"))
        return gathered(counts.unionByName(stay))
    plain = rows
    if heavy:
        few = F.broadcast(rows.sparkSession.createDataFrame([(h,) for h in heavy], "_hash long"))
        plain = rows.join(few, F.xxhash64(by) == F.col("_hash"), "left_anti")
    out = gathered(_folded(plain.sortWithinPartitions("cls", "own").repartition(by), by))
    if heavy:
        out = out.unionByName(gathered(_folded(_combined(rows.join(few, F.xxhash64(by) == F.col("_hash"), "left_semi"), by), by)))
    return out
