"""MinHash near-dedup with tensored banding.

Each text's set of word shingles gets two small collections of half keys: 10
left and 10 right, two minima each.  A table key is a pair (left i, right j),
so 40 minima serve 100 tables, where plain banding would compute 400.  Half
keys that only one set has cannot be part of a shared table key and are dropped
before the pairs are formed.

At a similarity of 0.75 a pair of texts misses every table with probability
0.0005, at 0.8 with 0.00007.  With the two sketches below, a link at 0.75 is lost
with probability 0.0006 at most, and a group only if all its links to the rest
are.  Candidates are confirmed on the full sets, held as 64-bit hashes of the
shingles; sets are told apart by their size and two 64-bit fingerprints.

Equal sets are merged first.  A table key then links its members to one hub (a
star, never all pairs): the member with the smallest share of shingles that no
other candidate has, which is next to the text the others are copies of.  What
the stars and their connected components leave apart is compared across
components only: in each key, those outside its largest component with hubs of
that component, then with all others.  Exact bounds stand before each
comparison: the sizes, and the size of a set without shingles of its own; edited
copies that are too far from everything drop out there.  So does a 64-bit sketch
of one-bit minima, wrong for a pair at 0.75 with probability 0.00007; the last
comparison also has one of 512 bits, wrong with probability 0.00003.

A key, component or text may hold a third of all rows: joins with one row a key
broadcast the heavy keys (``heavy_join``), aggregations combine before they
shuffle, and the comparison of all rows of a key is dealt over as many tasks as
the key has blocks of ``DEAL`` rows.

Defined results: A-Z are lower-cased, words are runs other than white space;
null, empty and blank texts have no shingles and link to nothing; texts shorter
than a shingle have their whole word sequence as one; rows that share an id are
told apart by their texts and decided each; a row with a null id has its
n_shingles but a null component, and is kept; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.operators.components import connected_components
from kinfold.operators.names import fresh
from kinfold.operators.salting import heavy_join
from kinfold.operators.scratch import numbered, passing, rank, settle

SHINGLE = 5
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Half keys on each side, and minima in each.
HALVES, MINIMA = 10, 2
#: One-bit minima of the sketch, and of the wide sketch of sets that stay undecided.
SKETCH, WIDE = 64, 512
#: Hubs of a component that a set beside it is compared with.
HUBS = 16
#: Rows of a key that one task compares with the others of the key.
DEAL = 1024
#: Shingles worked on together.
CHUNK = 1 << 17

_WORDS = 400_000
_MASK = (1 << 64) - 1


class _WordHashes(dict):
    """Word -> 64-bit hash, bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_hashes = _WordHashes()


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _odd(n: int, seed: str) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(f"{seed}{i}") | 1 for i in range(n)], "u8")


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    n = len(words)
    if not n:
        return np.empty(0, "u8")
    if n < shingle:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed=n)], "u8")
    w = np.fromiter(map(_hashes.__getitem__, words), "u8", n)
    out = np.zeros(n - shingle + 1, "u8")
    for k, factor in enumerate(_odd(shingle, "place")):
        out += w[k : k + len(out)] * factor
    return np.unique(_mixed(out))


def _fingerprint(x: np.ndarray, at: np.ndarray, factor: int) -> np.ndarray:
    """Sums over the sets that start at ``at``: equal for equal sets."""
    return np.add.reduceat(_mixed(x * np.uint64(factor)), at)


def _minima(x: np.ndarray, at: np.ndarray, total: int, seed: str) -> np.ndarray:
    """Mixed minima of ``total`` hash functions over the sets that start at ``at``."""
    low = np.empty((total, len(at)), "u8")
    for i, (a, b) in enumerate(zip(_odd(total, f"{seed}factor"), _odd(total, f"{seed}shift"), strict=True)):
        low[i] = np.minimum.reduceat(x * a + b, at)
    return _mixed(low)


def _one_bit(low: np.ndarray) -> np.ndarray:
    """Top bits of minima, 64 to a word: a row a word, a column a set."""
    bits = np.zeros((len(low) // 64, low.shape[1]), "u8")
    for i, row in enumerate(low):
        bits[i // 64] |= (row >> np.uint64(63)) << np.uint64(i % 64)
    return bits


def _joined(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Non-empty sets behind each other, and where each starts."""
    at = np.zeros(len(sets), "i8")
    np.cumsum([len(s) for s in sets[:-1]], out=at[1:])
    return np.concatenate(sets), at


def _signatures(sets: list[np.ndarray]) -> list[np.ndarray]:
    """(fp1, fp2, half keys, sketch) of non-empty sets."""
    x, at = _joined(sets)
    low = _minima(x, at, 2 * HALVES * MINIMA + SKETCH, "")
    halves = np.zeros((2 * HALVES, len(sets)), "u8")
    for m in range(MINIMA):
        halves = _mixed(halves * np.uint64(3) + low[m : 2 * HALVES * MINIMA : MINIMA])
    bits = _one_bit(low[2 * HALVES * MINIMA :])[0]
    fp = [_fingerprint(x, at, k) for k in (5, 11)]
    return [fp[0].view("i8"), fp[1].view("i8"), np.ascontiguousarray(halves.T).view("i8"), bits.view("i8")]


def _chunks(sets: list[np.ndarray]) -> Iterator[list[int]]:
    """Places of the non-empty sets, gathered until they hold CHUNK shingles."""
    held, have = [], 0
    for i, s in enumerate(sets):
        if len(s):
            held.append(i)
            have += len(s)
        if have >= CHUNK:
            yield held
            held, have = [], 0
    if held:
        yield held


def signature_udf(shingle: int = SHINGLE):
    """text -> struct(n, fp1, fp2, halves, bits)."""

    @F.pandas_udf("n long, fp1 long, fp2 long, halves array<long>, bits long")
    def signature(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            n = np.zeros(len(texts), "i8")
            fp1, fp2, bits = (np.zeros(len(texts), "i8") for _ in range(3))
            halves = [None] * len(texts)
            held, where, have = [], [], 0
            for i, t in enumerate([*texts, None]):
                s = shingle_hashes(t, shingle) if i < len(texts) else ()
                if len(s):
                    n[i] = len(s)
                    held.append(s)
                    where.append(i)
                    have += len(s)
                if held and (have >= CHUNK or i == len(texts)):
                    fp1[where], fp2[where], keys, bits[where] = _signatures(held)
                    for j, k in zip(where, keys, strict=True):
                        halves[j] = k
                    held, where, have = [], [], 0
            yield pd.DataFrame({"n": n, "fp1": fp1, "fp2": fp2, "halves": halves, "bits": bits})
        _hashes.clear()  # the worker lives on and may have other work

    return signature


def shingles_udf(shingle: int = SHINGLE):
    """text -> struct(fp1, fp2, full, wide): the fingerprints of its set, the
    set, and its wide sketch."""

    @F.pandas_udf("fp1 long, fp2 long, full array<long>, wide array<long>")
    def full(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            sets = [shingle_hashes(t, shingle) for t in texts]
            fp1, fp2, wide = np.zeros(len(sets), "i8"), np.zeros(len(sets), "i8"), [None] * len(sets)
            for some in _chunks(sets):
                x, at = _joined([sets[i] for i in some])
                fp1[some], fp2[some] = (_fingerprint(x, at, k).view("i8") for k in (5, 11))
                for i, w in zip(some, np.ascontiguousarray(_one_bit(_minima(x, at, WIDE, "wide")).T).view("i8"), strict=True):
                    wide[i] = w
            yield pd.DataFrame({"fp1": fp1, "fp2": fp2, "full": [s.view("i8") for s in sets], "wide": wide})
        _hashes.clear()

    return full.asNondeterministic()  # or a check of a field is moved below the join and runs it on all texts


def table_keys(reps: DataFrame) -> DataFrame:
    """(key, rep, l, r): the tensored table keys that at least two sets share,
    and the places of their two halves."""
    half = reps.select("rep", F.posexplode("halves").alias("place", "half"))
    shared = settle(half.groupBy("place", "half").agg(F.count("*").alias("c")).filter("c > 1"), "shared-halves")
    half = heavy_join(half, shared, ["place", "half"], "c", 2 * HALVES * reps.count()).drop("c")
    sides = half.groupBy("rep").agg(
        *[
            F.collect_list(F.when(F.col("place") < HALVES if left else F.col("place") >= HALVES, F.struct("place", "half"))).alias(name)
            for name, left in (("left", True), ("right", False))
        ]
    )  # at most HALVES entries each
    keys = sides.select("rep", F.explode("left").alias("l"), "right").select("rep", "l", F.explode("right").alias("r"))
    key = F.xxhash64("l.place", "l.half", "r.place", "r.half").alias("key")
    keys = settle(keys.select(key, "rep", F.col("l.place").cast("byte").alias("l"), F.col("r.place").cast("byte").alias("r")), "keys")
    members = settle(keys.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1"), "key-sizes")
    return settle(heavy_join(keys, members, ["key"], "c", keys.count(), once=True).drop("c"), "shared-keys")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The (a, b) of ``pairs`` whose full sets are similar enough."""
    a = sets.select(F.col("rep").alias("a"), F.col("full").alias("fa"))
    b = sets.select(F.col("rep").alias("b"), F.col("full").alias("fb"))
    both = pairs.join(a, "a").join(b, "b")
    common = F.size(F.array_intersect("fa", "fb"))
    either = F.size("fa") + F.size("fb") - common
    return both.filter(100 * common >= percent * either).select("a", "b")


def _beside(rows: DataFrame, hubs: DataFrame, by: str, on: str, each: int = 1) -> DataFrame:
    """``rows`` with hubs, in rep2, component2, n2, bits2 and most2, where ``by``
    of the rows is ``on`` of the hubs: those with the smallest share of shingles
    of their own, one in each of ``each`` classes.  They are next to the text
    that the others are copies of."""
    best = F.max(F.struct((F.col("most") / F.col("n")).alias("share"), "rep", "component", "n", "bits", "most")).alias("h")
    hub = hubs.groupBy(F.col(on).alias(by), F.pmod("rep", F.lit(each)).alias("_class")).agg(best)
    hub = hub.groupBy(by).agg(F.collect_list("h").alias("_hubs"))  # at most ``each``
    hub = settle(hub.join(rows.groupBy(by).agg(F.count("*").alias("_c")), by), "hubs")
    both = heavy_join(rows, hub, [by], "_c", rows.count(), once=True).withColumn("h", F.explode("_hubs")).drop("_hubs", "_c")
    return both.select(*rows.columns, *[F.col(f"h.{c}").alias(f"{c}2") for c in ("rep", "component", "n", "bits", "most")])


def _first_shared() -> Column:
    """Whether no key with smaller places is shared too, so that a pair of sets
    comes out of one of its keys only."""
    other = F.lit(False)
    for p in range(2 * HALVES):
        other = other | ((F.lit(p) < F.col("l" if p < HALVES else "r")) & (F.get("halves", F.lit(p)) == F.get("halves2", F.lit(p))))
    return ~other


def _may_differ(bits: int, percent: int) -> int:
    """Bits in which sketches of sets that are ``percent`` similar may differ: the
    mean and 4.2 deviations, 19 of 64 and 95 of 512 at 75."""
    p = (1 - percent / 100) / 2
    return int(bits * p + 4.2 * (bits * p * (1 - p)) ** 0.5)


def _likely(percent: int) -> Column:
    """What a link needs, for two sets with n, bits and most (the size without
    shingles of its own): exact bounds of sizes and intersection, and the sketch."""
    small, large = F.least("n", "n2"), F.greatest("n", "n2")
    reach = (100 + percent) * F.least("most", "most2") >= percent * (F.col("n") + F.col("n2"))
    near = F.bit_count(F.col("bits").bitwiseXOR(F.col("bits2"))) <= _may_differ(SKETCH, percent)
    return (F.col("component") != F.col("component2")) & (100 * small >= percent * large) & reach & near


def _near(percent: int) -> Column:
    """The wide sketches differ little."""
    differ = F.lit(0)
    for i in range(WIDE // 64):
        differ = differ + F.bit_count(F.get("wide", F.lit(i)).bitwiseXOR(F.get("wide2", F.lit(i))))
    return differ <= _may_differ(WIDE, percent)


def _undecided(placed: DataFrame) -> DataFrame:
    """Rows of keys with several components, with each key's largest (``major``)
    and its number of rows (``c``)."""
    parts = placed.groupBy("key", "component").agg(F.count("*").alias("c"))
    parts = parts.groupBy("key").agg(F.max(F.struct("c", "component")).alias("m"), F.count("*").alias("parts"), F.sum("c").alias("c"))
    parts = settle(parts.filter("parts > 1").select("key", "c", F.col("m.component").alias("major")), "parts")
    return heavy_join(placed, parts, ["key"], "c", placed.count(), once=True)


def classes(
    docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``."""
    base = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    signed = base.select("doc_id", F.monotonically_increasing_id().alias("row"), signature_udf(shingle)("text").alias("s"))
    signed = settle(signed.select("doc_id", "row", "s.*"), "signatures")
    same = ["n", "fp1", "fp2"]
    some = signed.filter("n > 0 and doc_id is not null")
    # equal sets are one; the number of its first row names it
    groups = some.groupBy(*same).agg(F.min("doc_id").alias("first_id"), F.min("row").alias("rep"), F.count("*").alias("copies"))
    groups = settle(groups, "sets")
    repeated = some.groupBy("doc_id").count().filter("count > 1").limit(1).count() > 0
    reps = settle(signed.join(groups.select("rep"), F.col("row") == F.col("rep")).select("rep", "n", "halves", "bits"), "reps")
    keys = table_keys(reps)
    candidates = settle(keys.select("rep").distinct(), "candidates")
    wanted = groups.join(candidates, "rep").select("rep", *[F.col(c).alias(f"{c}_") for c in same], "first_id")
    sets = base.join(wanted, base["doc_id"] == wanted["first_id"]).select("rep", "fp1_", "fp2_", shingles_udf(shingle)("text").alias("s"))
    sets = sets.filter("s.fp1 = fp1_ and s.fp2 = fp2_").select("rep", "s.full", "s.wide")  # ids that repeat have other texts too
    sets = settle(sets.dropDuplicates(["rep"]) if repeated else sets, "full-sets")
    # shingles that no other candidate has cannot be part of an intersection
    own = sets.select("rep", F.explode("full").alias("s")).groupBy("s").agg(F.count("*").alias("c"), F.min("rep").alias("rep"))
    own = own.filter("c = 1").groupBy("rep").agg(F.count("*").alias("own"))
    light = reps.join(candidates, "rep", "left_semi").join(own, "rep", "left").select(
        "rep", "n", "bits", (F.col("n") - F.coalesce("own", F.lit(0))).alias("most")
    )
    rows = settle(keys.join(light.filter(100 * F.col("most") >= percent * F.col("n")), "rep"), "rows")

    def placed(found: DataFrame) -> DataFrame:
        at = found.select(F.col("node").alias("rep"), "component")
        return settle(rows.join(at, "rep", "left").withColumn("component", F.coalesce("component", "rep")), "placed")

    # stars: each set with the best hub of its keys
    alone = rows.withColumn("component", F.col("rep"))
    stars = _beside(alone, alone, "key", "key").filter(_likely(percent))  # a row a key, so the rows' keys are all there
    stars = stars.groupBy("rep").agg(F.max_by("rep2", F.struct(F.col("most2") / F.col("n2"), "rep2")).alias("rep2"))
    tried = settle(stars.select(F.col("rep2").alias("a"), F.col("rep").alias("b")), "tried")
    links = settle(confirmed(tried, sets, percent), "links")
    found = connected_components(links)

    # those outside a key's largest component with hubs of that component
    still = settle(_undecided(placed(found)), "undecided")
    outside = settle(still.filter("component <> major").select("rep", "component", "n", "bits", "most", "major").distinct(), "outside")
    inside = still.filter("component = major").select("rep", "component", "n", "bits", "most").distinct()
    again = _beside(outside, inside, "major", "component", HUBS).filter(_likely(percent))
    again = again.select(F.col("rep2").alias("a"), F.col("rep").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
    links = settle(links.unionByName(confirmed(again, sets, percent)), "links")
    found = connected_components(links)

    # and what is left of them with all others, each pair in its first key
    still = _undecided(placed(found)).join(reps.select("rep", "halves"), "rep").join(sets.select("rep", "wide"), "rep")
    still = settle(still, "undecided")
    # the rows outside are dealt over copies of their key's rows, as many as it has blocks
    tables = F.ceil(F.col("c") / DEAL)
    others = still.select("key", F.explode(F.sequence(F.lit(0), tables - 1)).alias("_deal"), *[F.col(c).alias(f"{c}2") for c in ("rep", "component", "n", "bits", "most", "halves", "wide")])
    dealt = still.filter("component <> major").withColumn("_deal", F.pmod(F.xxhash64("rep"), tables))
    across = dealt.join(others, ["key", "_deal"]).filter(_likely(percent) & _near(percent) & _first_shared())
    across = across.select(F.least("rep", "rep2").alias("a"), F.greatest("rep", "rep2").alias("b")).distinct()
    links = settle(links.unionByName(confirmed(across, sets, percent)), "links")
    found = connected_components(links)

    known = groups.join(found, F.col("rep") == F.col("node"), "left")
    known = settle(known.select(*same, "first_id", "copies", F.coalesce("component", "rep").alias("component")), "known")
    smallest = known.groupBy("component").agg(F.min("first_id").alias("component_id"), F.count("*").alias("_sets"))
    known = heavy_join(known, settle(smallest, "smallest"), ["component"], "_sets", known.count())
    known = settle(known.select(*same, "copies", "component_id"), "components")
    out = heavy_join(some.select("doc_id", *same), known, same, "copies", some.count()).select("doc_id", "n", "component_id")
    rest = signed.filter("n = 0 or doc_id is null").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return out.unionByName(rest).select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    )


def survivors(docs: DataFrame, id: str = "doc_id", text: str = "text", **params) -> DataFrame:
    """``docs`` with one row of each class: the one with the smallest id.  Rows
    are told apart by row, so null ids (which come last) and repeated ids are
    compared like all others."""
    (row,) = fresh(docs.columns, "row")
    with passing(docs.sparkSession) as keep:
        rows = numbered(docs, row, keep)
        found = classes(rows, row, text, **params).select(F.col("doc_id").alias("node"), "component_id")
        keyed = rows.select(F.col(row).alias("node"), rank(id, row).alias("key"))
        first = found.join(keyed, "node").groupBy("component_id").agg(F.min("key").alias("key"))
        kept = keep(first.select(F.col("key.row").alias(row)), "survivors")
    return rows.join(kept.hint("merge"), row, "left_semi").select(*docs.columns)
