"""Phrase collocations by multikey three-way quicksort of suffix pointers.

Every word of a text starts a *suffix* of up to four words inside its piece.
Sorting pointers to the suffixes puts equal phrases side by side, and the sizes
of the equal partitions are the phrases' counts:

1. ``suffix_blocks``: blocks of text become tables of words and of distinct
   suffixes with their counts (pre-aggregation); they are settled once.
2. ``route``: suffixes go to buckets by a hash of their two leading words, so all
   occurrences of a phrase meet in one bucket.  Pairs (triples) that hold many
   rows are routed by three (four) words, and their own counts are summed up over
   the buckets.  The number of buckets follows the number of rows.
3. ``count_phrases``: inside a bucket the pointers of each leading pair are parted
   by their next word into less, equal and greater, again and again, all
   partitions of a round at once.  Equal partitions are counted and parted by the
   word behind; partitions of fewer occurrences than asked for are abandoned.
4. Scores, inclusion in longer phrases and ranks are joins and aggregations over
   the counted phrases.

Nothing is sampled: hashes only decide where a suffix is counted, and the phrases
are compared by their words.  Broadcast is an array of at most ``4 * HOT`` hashes.

Defined results: a null text counts as empty, a null language as ``und``; an
empty table gives no rows; texts of repeated rows count each; a text of any
length is cut at piece borders only; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinfold.operators.salting import heavy_join
from kinfold.operators.scratch import settle

from .packing import pack, pack_strings, unpack, unpack_strings

DEPTH = 4
#: Bytes of text of a block, and suffixes of a bucket on average.
BLOCK_BYTES, ROOM = 4 << 20, 1 << 20
#: Leading pairs and triples with more than one in HOT rows are routed by one more word.
HOT = 200_000
#: Phrases that are ranked in one task.
RANKED = 200_000

SEPARATORS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
_KIND = np.zeros(256, np.uint8)
_KIND[list(BLANKS)], _KIND[list(SEPARATORS)] = 1, 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


# -- blocks of suffixes -----------------------------------------------------------


def _bytes_of(column: pa.Array) -> bytes:
    """The values of a binary column, one after the other."""
    at = np.frombuffer(column.buffers()[1], "<i4")[column.offset : column.offset + len(column) + 1]
    return column.buffers()[2].to_pybytes()[at[0] : at[-1]] if len(column) and at[-1] > at[0] else b""


def _cut(data: bytes, size: int) -> Iterator[bytes]:
    """Parts of about ``size`` bytes that end behind a separator."""
    ends = np.flatnonzero(_KIND[np.frombuffer(data, np.uint8)] == 2) + 1
    start = 0
    while start < len(data):
        i = int(np.searchsorted(ends, start + size, "right"))
        end = int(ends[i - 1]) if i and ends[i - 1] > start else int(ends[i]) if i < len(ends) else len(data)
        yield data[start:end]
        start = end


def _suffixes(codes: np.ndarray, piece: np.ndarray) -> list[np.ndarray]:
    """For each word, the codes of the DEPTH words from it on; 0 behind its piece."""
    out = [codes]
    for d in range(1, DEPTH):
        ahead = np.zeros_like(codes)
        same = piece[d:] == piece[: len(piece) - d]
        ahead[: len(codes) - d][same] = codes[d:][same]
        out.append(ahead)
    return out


def _distinct(keys: Sequence[np.ndarray], top: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct suffixes in order, and how often each occurs."""
    if top < 1 << 16:
        packed = np.zeros(len(keys[0]), np.uint64)
        for k in keys:
            packed = packed << np.uint64(16) | k.astype(np.uint64)
        found, counts = np.unique(packed, return_counts=True)
        return [(found >> np.uint64(16 * (DEPTH - 1 - d)) & np.uint64(0xFFFF)).astype(np.uint32) for d in range(DEPTH)], counts
    pairs, halves = [], []
    for a, b in ((0, 1), (2, 3)):
        known, at = np.unique(keys[a].astype(np.uint64) << np.uint64(32) | keys[b].astype(np.uint64), return_inverse=True)
        pairs.append(known)
        halves.append(at.astype(np.uint64))
    found, counts = np.unique(halves[0] << np.uint64(32) | halves[1], return_counts=True)
    sides = pairs[0][found >> np.uint64(32)], pairs[1][found & np.uint64(0xFFFFFFFF)]
    return [(s >> np.uint64(32 - 32 * d) & np.uint64(0xFFFFFFFF)).astype(np.uint32) for s in sides for d in (0, 1)], counts


def _block(data: bytes) -> dict:
    """Words, their counts, and distinct suffixes of two words and more, by code
    (place in the words, from 1 on)."""
    raw = np.frombuffer(data, np.uint8)
    kind = _KIND[raw]
    word = kind == 0
    edge = np.diff(word.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype("i4")
    spelled = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(_LOWER[raw[word]])])
    coded = spelled.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.uint32) + 1
    piece = np.searchsorted(np.flatnonzero(kind == 2), starts)
    longer = _suffixes(codes, piece)
    more = longer[1] > 0
    keys, counts = _distinct([k[more] for k in longer], len(coded.dictionary))
    uses = np.bincount(codes, minlength=len(coded.dictionary) + 1)[1:]
    return {
        "n": len(counts), "n_words": len(codes), "words": pack_strings(coded.dictionary), "word_counts": pack(uses),
        "keys": pack(np.concatenate(keys)), "counts": pack(counts),
    }


_BLOCK = pa.schema([("lang", pa.string()), ("n", pa.int64()), ("n_words", pa.int64()), *[(c, pa.binary()) for c in ("words", "word_counts", "keys", "counts")]])
_BLOCK_TYPE = "lang string, n long, n_words long, words binary, word_counts binary, keys binary, counts binary"


def suffix_blocks(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """A row for each block of texts of one language; settled."""

    full = BLOCK_BYTES

    def flushed(lang: str, waiting: list[bytes]) -> Iterator[pa.RecordBatch]:
        for part in _cut(b"".join(waiting), full):
            one = _block(part)
            if one["n_words"]:
                yield pa.RecordBatch.from_pydict({"lang": [lang]} | {k: [v] for k, v in one.items()}, schema=_BLOCK)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[str, list[bytes]] = {}
        size: dict[str, int] = {}
        for batch in batches:
            langs = batch.column("lang").dictionary_encode()
            for code, lang in enumerate(langs.dictionary.to_pylist()):
                data = _bytes_of(batch.column("raw").filter(pc.equal(langs.indices, code)))
                waiting.setdefault(lang, []).append(data)
                size[lang] = size.get(lang, 0) + len(data)
            for lang in [x for x in waiting if size[x] >= full] if sum(size.values()) < 4 * full else list(waiting):
                yield from flushed(lang, waiting.pop(lang))
                size.pop(lang)
        for lang, rest in waiting.items():
            yield from flushed(lang, rest)

    raw = F.concat(F.coalesce(F.col(text), F.lit("")), F.lit("\n")).cast("binary")
    rows = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), raw.alias("raw"))
    return settle(rows.mapInArrow(blocks, _BLOCK_TYPE), "suffix-blocks")


# -- routing ------------------------------------------------------------------------


def _mix(h: np.ndarray, more: np.ndarray) -> np.ndarray:
    h = (h ^ more) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def _unpacked(lang: str, words: pa.Array, keys: bytes, n: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Columns of codes, and for two, three and four leading words their hashes."""
    columns = list(unpack(keys, DEPTH * n).reshape(DEPTH, n))
    own = np.array([0, *(zlib.crc32(w) + 1 for w in words.to_pylist())], np.uint64)
    h, hashes = np.full(n, zlib.crc32(lang.encode()), np.uint64), []
    for d, k in enumerate(columns):
        h = _mix(h, own[k])
        if d:
            hashes.append(h)
    return columns, hashes


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(lang, words, keys, counts, n) of each block with suffixes."""
    for batch in batches:
        for lang, words, keys, counts, n in zip(*(batch.column(c) for c in ("lang", "words", "keys", "counts", "n")), strict=True):
            if n.as_py():
                yield lang.as_py(), unpack_strings(words.as_py()), keys.as_py(), counts.as_py(), n.as_py()


def hot_prefixes(blocks: DataFrame, total: int) -> np.ndarray:
    """Hashes of leading pairs and triples with more than one in HOT of the
    ``total`` suffixes (and room to gain something by parting them), and some with
    more than half of that.

    A block names what holds more than half of the share in it.  What it leaves
    out is less than half of the share altogether, so no such prefix is missed;
    there are at most ``4 * HOT`` of them."""
    share = max(total // HOT, ROOM // 4) / max(total, 1)

    def locally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, words, keys, _, n in _rows_of(batches):
            columns, hashes = _unpacked(lang, words, keys, n)
            for h, last in zip(hashes[:2], columns[1:], strict=False):
                known, rows = np.unique(h[last > 0], return_counts=True)
                often = rows > share * n / 2
                yield pa.RecordBatch.from_arrays([pa.array(known[often].view("i8")), pa.array(rows[often])], names=["prefix", "n"])

    named = blocks.select("lang", "words", "keys", "counts", "n").mapInArrow(locally, "prefix long, n long")
    hot = named.groupBy("prefix").agg(F.sum("n").alias("n")).filter(F.col("n") > share * total / 2).select("prefix")
    return np.sort(np.array([r.prefix for r in hot.collect()], "i8").view("u8"))


_ROUTED = pa.schema([("bucket", pa.int64()), ("depth", pa.int32()), ("lang", pa.string()), ("n", pa.int64()), *[(c, pa.binary()) for c in ("words", "keys", "counts")]])


def route(blocks: DataFrame, total: int) -> DataFrame:
    """(bucket, depth, lang, n, words, keys, counts): parts of blocks whose suffixes
    share a bucket, and by how many words they got there."""
    spark = blocks.sparkSession
    hot = spark.sparkContext.broadcast(hot_prefixes(blocks, total))
    buckets = np.uint64(max(spark.sparkContext.defaultParallelism, -(-total // ROOM)))

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, words, keys, counts, n in _rows_of(batches):
            weights = unpack(counts, n)
            columns, (two, three, four) = _unpacked(lang, words, keys, n)
            deep = np.isin(two, hot.value)
            deeper = deep & np.isin(three, hot.value)
            depth = 2 + deep.astype(np.uint64) + deeper
            bucket = np.where(deeper, four, np.where(deep, three, two)) % buckets
            way = bucket * np.uint64(8) + depth
            order = np.argsort(way, kind="stable")
            ways, starts = np.unique(way[order], return_index=True)
            for w, start, end in zip(ways, starts, [*starts[1:], n], strict=True):
                at = order[start:end]
                own = [k[at] for k in columns]
                used = np.zeros(len(words) + 1, bool)
                for k in own:
                    used[k] = True
                used[0] = False
                code = np.cumsum(used).astype(np.uint32) * used
                spelled, codes = words.filter(pa.array(used[1:])), np.concatenate([code[k] for k in own])
                row = [int(w) >> 3, int(w) & 7, lang, len(at), pack_strings(spelled), pack(codes), pack(weights[at])]
                yield pa.RecordBatch.from_pydict({c: [v] for c, v in zip(_ROUTED.names, row, strict=True)}, schema=_ROUTED)

    rows = blocks.select("lang", "words", "keys", "counts", "n")
    return rows.mapInArrow(routed, "bucket long, depth int, lang string, n long, words binary, keys binary, counts binary")


# -- the sort -------------------------------------------------------------------------


def _sums(weights: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums over neighbouring runs, none of which is empty."""
    return np.add.reduceat(weights, np.cumsum(lengths) - lengths) if len(lengths) else np.zeros(0, np.int64)


def _kept(pointers: np.ndarray, lengths: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return pointers[np.repeat(keep, lengths)], lengths[keep]


def _parted(pointers: np.ndarray, lengths: np.ndarray, key: np.ndarray, weights: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Partitions of pointers, each equal in one more word: all partitions of a
    round are parted at once around the word of their middle pointer.  Those of
    less than ``least`` occurrences are abandoned."""
    done, sizes = [pointers[:0]], [lengths[:0]]
    while len(pointers):
        own = key[pointers]
        middle = np.repeat(own[np.cumsum(lengths) - lengths + lengths // 2], lengths)
        segment = np.repeat(np.arange(len(lengths)), lengths)
        sides = []
        for side in (own < middle, own > middle, own == middle):
            size = np.bincount(segment[side], minlength=len(lengths))
            part, size = pointers[side], size[size > 0]
            sides.append(_kept(part, size, _sums(weights[part], size) >= least))
        done.append(sides[2][0])
        sizes.append(sides[2][1])
        pointers, lengths = (np.concatenate(x) for x in zip(*sides[:2], strict=True))
    return np.concatenate(done), np.concatenate(sizes)


def equal_partitions(keys: Sequence[np.ndarray], lead: np.ndarray, weights: np.ndarray, least: int, whole: int = 2) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(words, a pointer into each partition, its occurrences) of the phrases of
    two words and more with at least ``least`` occurrences.

    ``keys`` has the words of each suffix (0: none), ``lead`` a number for its two
    leading words.  Suffixes that were routed by ``whole`` words may have others
    elsewhere that share fewer, so shorter phrases are given with any count."""
    pointers = np.argsort(lead, kind="stable")
    ordered = lead[pointers]
    starts = np.flatnonzero(np.diff(ordered, prepend=ordered[:1] - 1))
    lengths = np.diff(starts, append=len(pointers))
    for d in range(2, len(keys) + 1):
        count = _sums(weights[pointers], lengths)
        often = count >= (least if d >= whole else 1)
        pointers, lengths = _kept(pointers, lengths, often)
        yield d, pointers[np.cumsum(lengths) - lengths], count[often]
        if d < len(keys):
            if d + 1 >= whole:  # what is longer is all here
                pointers, lengths = _kept(pointers, lengths, count[often] >= least)
            ahead = keys[d][pointers] > 0
            lengths = np.bincount(np.repeat(np.arange(len(lengths)), lengths)[ahead], minlength=len(lengths))
            pointers, lengths = _parted(pointers[ahead], lengths[lengths > 0], keys[d], weights, least if d + 1 >= whole else 1)


_PHRASE = pa.schema([("lang", pa.string()), ("len", pa.int32()), ("phrase", pa.binary()), ("f", pa.int64())])


def _counted(rows: pa.Table, least: int, whole: int) -> Iterator[pa.Table]:
    """Phrases of one bucket's suffixes that were routed by ``whole`` words."""
    langs = rows.column("lang").combine_chunks().dictionary_encode()
    lists = [unpack_strings(w.as_py()) for w in rows.column("words")]
    known = pa.concat_arrays(lists).dictionary_encode()
    code, sizes = known.indices.to_numpy(zero_copy_only=False).astype(np.uint32) + 1, rows.column("n").to_pylist()
    weights = np.concatenate([unpack(c.as_py(), n) for c, n in zip(rows.column("counts"), sizes, strict=True)]).astype(np.int64)
    columns, done = [], 0
    for packed, n, words in zip(rows.column("keys"), sizes, map(len, lists), strict=True):
        own = np.concatenate([np.zeros(1, np.uint32), code[done : done + words]])
        columns.append(own[unpack(packed.as_py(), DEPTH * n).reshape(DEPTH, n)])
        done += words
    keys = list(np.concatenate(columns, axis=1))
    lang = np.repeat(langs.indices.to_numpy(zero_copy_only=False), sizes).astype(np.int64)
    top = len(known.dictionary) + 1
    lead = (lang * top + keys[0]) * top + keys[1]
    spell = lambda k: known.dictionary.take(pa.array(k - 1))
    for d, at, count in equal_partitions(keys, lead, weights, least, whole):
        phrase = pc.binary_join_element_wise(*[spell(keys[i][at]) for i in range(d)], b" ")
        yield pa.table([langs.dictionary.take(pa.array(lang[at])), pa.array(np.full(len(at), d, np.int32)), phrase, pa.array(count)], schema=_PHRASE)


def count_phrases(routed: DataFrame, least: int) -> DataFrame:
    """(lang, len, phrase, f) of all phrases of two words and more with at least
    ``least`` occurrences."""

    def sort(bucket: pa.Table) -> pa.Table:
        found = [_PHRASE.empty_table()]
        for whole in range(2, DEPTH + 1):
            rows = bucket.filter(pc.equal(bucket.column("depth"), whole))
            if len(rows):
                found += _counted(rows, least, whole)
        return pa.concat_tables(found)

    parts = routed.groupBy("bucket").applyInArrow(sort, "lang string, len int, phrase binary, f long")
    whole = parts.groupBy("lang", "len", F.col("phrase").cast("string").alias("phrase")).agg(F.sum("f").alias("f"))
    return whole.filter(F.col("f") >= least)


def word_counts(blocks: DataFrame) -> DataFrame:
    """(lang, phrase, f) of all words."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, words, counts in zip(*(batch.column(c) for c in ("lang", "words", "word_counts")), strict=True):
                own = unpack_strings(words.as_py())
                columns = [pa.array([lang.as_py()] * len(own), pa.string()), own, pa.array(unpack(counts.as_py(), len(own)).astype(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "word", "n"])

    rows = blocks.select("lang", "words", "word_counts").mapInArrow(listed, "lang string, word binary, n long")
    return rows.groupBy("lang", F.col("word").cast("string").alias("phrase")).agg(F.sum("n").alias("f"))


def phrase_counts(docs: DataFrame, least: int, text: str = "text", lang: str = "lang") -> tuple[DataFrame, DataFrame]:
    """((lang, len, phrase, f) of all phrases of up to four words with at least
    ``least`` occurrences, settled; (lang, n): words of each language)."""
    blocks = suffix_blocks(docs, text, lang)
    total = blocks.agg(F.sum("n")).first()[0] or 0
    words = word_counts(blocks).filter(F.col("f") >= least)
    longer = count_phrases(route(blocks, total), least)
    counts = words.select("lang", F.lit(1).alias("len"), "phrase", "f").unionByName(longer)
    return settle(counts, "phrases"), blocks.groupBy("lang").agg(F.sum("n_words").alias("n"))


# -- scores ---------------------------------------------------------------------------


def _joined(words: Column, start: Column | int, n: Column | int) -> Column:
    return F.array_join(F.slice(words, start, n), " ")


def _looked_up(rows: DataFrame, counts: DataFrame, key: str, into: str, total: int) -> DataFrame:
    """``rows`` with the counts of the phrases in ``key``, where many rows may
    share one."""
    one = counts.select("lang", F.col("phrase").alias(key), F.col("f").alias(into))
    one = settle(one.join(rows.groupBy("lang", key).agg(F.count("*").alias("_n")), ["lang", key]), "parts")
    return heavy_join(rows, one, ["lang", key], "_n", total).drop("_n")


def scored(counts: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score) of all phrases of two words and more, by
    their lowest-scoring cut; of equal ones, the first."""
    longer = counts.filter("len > 1").withColumn("words", F.split("phrase", " "))
    cuts = longer.select("lang", "phrase", F.col("f").alias("a"), "words", F.explode(F.sequence(F.lit(1), F.col("len") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _joined(F.col("words"), 1, F.col("k")).alias("first"), _joined(F.col("words"), F.col("k") + 1, F.size("words") - F.col("k")).alias("rest"))
    cuts = settle(cuts, "cuts")
    total = cuts.count()
    both = settle(_looked_up(cuts, counts, "first", "l", total).drop("first"), "cuts-first")
    both = _looked_up(both, counts, "rest", "r", total)
    score = F.expr("cast(a as decimal(20,0)) * 2000000BD div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    low = both.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("low"))
    return low.select("lang", "phrase", "a", "low.l", "low.r", "low.score")


def longest_holders(counts: DataFrame) -> DataFrame:
    """(lang, phrase, within): the most frequent longer phrase around each."""
    longer = counts.filter("len > 2").withColumn("words", F.split("phrase", " "))
    sizes = F.sequence(F.lit(2), F.col("len") - 1)
    parts = F.flatten(F.transform(sizes, lambda n: F.transform(F.sequence(F.lit(1), F.col("len") - n + 1), lambda at: _joined(F.col("words"), at, n))))
    return longer.select("lang", F.explode(F.array_distinct(parts)).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("within"))


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, percent: int = 80, text: str = "text", lang: str = "lang") -> DataFrame:
    """Each language's first ``top`` phrases by score: lang, rank, phrase, a (its
    occurrences), l and r (those of its two parts), n (words of the language) and
    score.  Phrases inside a longer one with at least ``percent`` per cent of their
    occurrences are left out."""
    counts, sizes = phrase_counts(docs, least, text, lang)
    inside = F.col("within").cast("decimal(20,0)") * 100 >= F.col("a").cast("decimal(20,0)") * percent
    left = settle(scored(counts).join(longest_holders(counts), ["lang", "phrase"], "left").filter(F.col("within").isNull() | ~inside).drop("within"), "scored")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salts = -(-left.count() // RANKED) or 1
    near = Window.partitionBy("lang", "_salt").orderBy(*order)
    first = left.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(salts))).withColumn("rank", F.row_number().over(near)).filter(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
