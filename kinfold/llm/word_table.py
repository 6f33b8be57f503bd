"""BPE encoding and decoding through a table of distinct words.

Words repeat, so a corpus has far fewer distinct words than words:

1. Spark splits the texts into words.  Each block of rows (an Arrow batch, of
   about ``BLOCK_WORDS`` words at most) becomes a list of its distinct words and
   the *places* of all its words in that list.  Blocks are settled once, so words
   are split once.
2. The lists are dealt by a hash of the word, in packed slices, so all rows of a
   word meet: the table of distinct words, each of which is encoded once.
3. The ids go back to the blocks, where they are joined by position.
4. Decoding joins each id of a text with its piece.  The vocabulary has a fixed
   size, so that join is by broadcast: an array with the piece of id i at place i.

What is shuffled are the lists (each word of a block once) and a packed number for
each word; a frequent word is there once a block, so no key is hot.  Nothing but
the vocabulary is broadcast.

Defined results: a null text counts as empty and has no ids; special strings in a
text are one id each; repeated rows are encoded each; ids that the vocabulary
lacks decode to nothing; other columns of any name come along, except those that
the operator names, which are replaced; empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinfold.operators.names import fresh
from kinfold.operators.scratch import numbered, settle

from .bpe import vocabulary
from .packing import pack, pack_strings, unpack, unpack_strings
from .prefix_bpe import PrefixBpe, ranks_of_json

#: Words of a block; one text is never parted, so a block may have more.
BLOCK_WORDS = 1 << 23


class Vocabulary:
    """Ids of words and bytes of ids, from the content of a tokenizer.json."""

    def __init__(self, content: bytes, pattern: str):
        ranks, _ = ranks_of_json(content)
        self.bpe = PrefixBpe(ranks, pattern)
        self.special = {t["content"]: t["id"] for t in json.loads(content).get("added_tokens", [])}

    def ids(self, word: str) -> list[int]:
        """Ids of one word (a special string, or a piece of the pattern)."""
        known = self.special.get(word)
        return self.bpe.encode_piece(word.encode()) if known is None else [known]

    def pieces(self) -> dict[int, bytes]:
        return self.bpe.bytes_of | {i: s.encode() for s, i in self.special.items()}


@lru_cache(maxsize=2)
def loaded(content: bytes, pattern: str) -> Vocabulary:
    return Vocabulary(content, pattern)


@lru_cache(maxsize=2)
def pieces_of(content: bytes, pattern: str) -> pa.Array:
    return _by_id(loaded(content, pattern))


@F.pandas_udf(T.StringType())
def _shown(raw: pd.Series) -> pd.Series:
    return raw.map(lambda b: bytes(b).decode("utf-8", "replace"))


def words_of(text: Column, pattern: str, special: Sequence[str]) -> Column:
    """The words of a text, which joined give the text again: special strings
    first, then what the pattern matches between them."""
    unicode = F.lit("(?U)" + pattern)  # \s and \S as Unicode has them
    plain = lambda t: F.regexp_extract_all(t, unicode, F.lit(0))
    text = F.coalesce(text, F.lit(""))
    if not special:
        return plain(text)
    either = "|".join(rf"\Q{s}\E" for s in sorted(special, key=len, reverse=True))
    parts = F.regexp_extract_all(text, F.lit(rf"(?s){either}|.+?(?={either}|\z)"), F.lit(0))
    cut = F.flatten(F.transform(parts, lambda p: F.when(p.isin(*special), F.array(p)).otherwise(plain(p))))
    return F.when(text.rlike(either), cut).otherwise(plain(text))


def _slices(lengths: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Runs of rows with about ``size`` words."""
    start, upto = 0, np.cumsum(lengths)
    while start < len(lengths):
        before = int(upto[start - 1]) if start else 0
        end = max(start + 1, int(np.searchsorted(upto, before + size, "right")))
        yield start, end
        start = end


def _ranked(places: np.ndarray, words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Places and words by falling number of uses, places counting from 1 on; what
    is used once comes last, in order, and is marked by 0."""
    uses = np.bincount(places, minlength=len(words))
    order = np.argsort(-uses, kind="stable")
    rank = np.empty(len(words), np.int64)
    rank[order] = np.arange(1, len(words) + 1)
    rank[uses == 1] = 0
    return rank[places], words.take(pa.array(order))


def _unranked(marked: np.ndarray, words: int) -> np.ndarray:
    """Places from 0 on again."""
    once = marked == 0
    return np.where(once, words - once.sum() + np.cumsum(once), marked) - 1


_SLICE = pa.struct([("bucket", pa.int32()), ("n", pa.int32()), ("at", pa.binary()), ("words", pa.binary())])
_SLICES = "array<struct<bucket: int, n: int, at: binary, words: binary>>"
_OWN = {"block": "long", "row": "int", "n": "int", "places": "binary", "slices": _SLICES}


def _slices_of(words: pa.Array, buckets: int) -> list[dict]:
    """Distinct words by the hash that deals them, with their places."""
    if not len(words):
        return []
    way = np.array([zlib.crc32(w) % buckets for w in words.to_pylist()], np.int64)
    order = np.argsort(way, kind="stable")
    starts = np.flatnonzero(np.diff(way[order], prepend=-1))
    out = []
    for start, end in zip(starts, [*starts[1:], len(order)], strict=True):
        at = order[start:end]
        out.append({"bucket": int(way[at[0]]), "n": len(at), "at": pack(np.diff(at, prepend=0)), "words": pack_strings(words.take(pa.array(at)))})
    return out


def blocks(docs: DataFrame, words: Column, columns: Sequence[str]) -> DataFrame:
    """``columns`` as c0, c1, ... with the block of each row, its place there and
    its number of words; a block's first row has the places of all words and the
    slices of the distinct ones; settled."""
    spark = docs.sparkSession
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)], words.alias("words"))
    most, buckets = BLOCK_WORDS, max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for start, end in _slices(batch.column("words").value_lengths().to_numpy(zero_copy_only=False), most):
                part, n = batch.slice(start, end - start), end - start
                lists = part.column("words")
                coded = lists.flatten().dictionary_encode()
                places, distinct = _ranked(coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.cast(pa.binary()))
                first = [_slices_of(distinct, buckets)]
                made = [np.full(n, number), np.arange(n, dtype="i4"), lists.value_lengths(), [pack(places)] + [None] * (n - 1), first + [None] * (n - 1)]
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.list_(_SLICE)]
                number += 1
                yield pa.RecordBatch.from_arrays(part.columns[:-1] + [pa.array(m, k) for m, k in zip(made, kinds, strict=True)], names=names)

    schema = T.StructType([*rows.schema.fields[:-1], *T.StructType.fromDDL(", ".join(f"{n} {t}" for n, t in _OWN.items())).fields])
    names = schema.names
    return settle(rows.mapInArrow(cut, schema), "word-blocks")


def _gathered(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The values of lists, which stand one after the other, of the lists ``at``."""
    size = lengths[at]
    return flat[np.repeat(starts[at] - np.cumsum(size) + size, size) + np.arange(size.sum())]


_IDS = pa.schema([("of", pa.int64()), ("n", pa.int32()), ("n_ids", pa.int64()), ("at", pa.binary()), ("lengths", pa.binary()), ("ids", pa.binary())])


def word_ids(slices: DataFrame, content, pattern: str) -> DataFrame:
    """The slices with ids in place of words: each bucket's distinct words are
    encoded once."""

    def encoded(bucket: pa.Table) -> pa.Table:
        own, rows = loaded(content.value, pattern), bucket.to_pylist()
        words = pa.concat_arrays([unpack_strings(r["words"]) for r in rows]).dictionary_encode()
        ids = [own.ids(w.decode()) for w in words.dictionary.to_pylist()]
        lengths = np.array([len(x) for x in ids], np.int64)
        flat, starts = np.fromiter(chain.from_iterable(ids), np.int64), np.cumsum(lengths) - lengths
        places, done, out = words.indices.to_numpy(zero_copy_only=False), 0, []
        for r in rows:
            at = places[done : done + r["n"]]
            own_ids = _gathered(flat, starts, lengths, at)
            out.append({"of": r["block"], "n": r["n"], "n_ids": len(own_ids), "at": r["at"], "lengths": pack(lengths[at]), "ids": pack(own_ids)})
            done += r["n"]
        return pa.Table.from_pylist(out, _IDS)

    return slices.groupBy("bucket").applyInArrow(encoded, "of long, n int, n_ids long, at binary, lengths binary, ids binary")


def pieces(spark: SparkSession, own: Vocabulary) -> DataFrame:
    """(id, piece): as many rows as the vocabulary has, which bounds its broadcast."""
    return spark.createDataFrame(pd.DataFrame(sorted(own.pieces().items()), columns=["id", "piece"]), "id int, piece binary")


def joined_pieces(rows: DataFrame, table: DataFrame, key: str, ids: str, into: str) -> DataFrame:
    """``key``, ``ids`` and ``into``, the bytes that the ids of each row stand for,
    by a join on the id; ``key`` is unique."""
    each = rows.select(key, F.posexplode(ids).alias("_at", "_id")).join(F.broadcast(table), F.col("_id") == F.col("id"))
    spelled = each.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("_at", "piece"))).alias("_pieces"))
    joined = F.aggregate(F.col("_pieces.piece"), F.lit(bytearray()), lambda done, piece: F.concat(done, piece))
    return rows.join(spelled, key, "left").select(key, ids, F.coalesce(joined, F.lit(bytearray())).alias(into))


def _by_id(own: Vocabulary) -> pa.Array:
    """The piece of id i at place i; ids between that have none are empty."""
    spelled = own.pieces()
    return pa.array([spelled.get(i, b"") for i in range(max(spelled, default=-1) + 1)], pa.binary())


def _spelled(by_id: pa.Array, ids: np.ndarray) -> memoryview:
    """The pieces of ids, one after the other."""
    taken = by_id.take(pa.array(ids))
    if not len(taken):
        return memoryview(b"")
    return memoryview(taken.buffers()[2])[: np.frombuffer(taken.buffers()[1], "<i4")[len(taken)]]


def _assembler(content, pattern: str, digests: bool, made: Sequence[str]):
    """(rows of a block, ids of its words) -> rows with the ids of the whole
    texts, or with digests of the ids and of what they decode to."""

    def texts(rows: pa.Table, slices: list[dict]) -> Iterator[np.ndarray]:
        """Ids of each row: those of its words, joined by position."""
        counts = rows.column("n").to_numpy()
        places = _unranked(unpack(rows.column("places")[0].as_py(), int(counts.sum())).astype(np.int64), sum(s["n"] for s in slices))
        at = [np.cumsum(unpack(s["at"], s["n"]).astype(np.int64)) for s in slices]
        size = [unpack(s["lengths"], s["n"]).astype(np.int64) for s in slices]
        flat = np.concatenate([np.zeros(0, np.uint32), *[unpack(s["ids"], s["n_ids"]) for s in slices]])
        lengths, starts = np.zeros((2, sum(s["n"] for s in slices)), np.int64)
        if slices:
            order, n = np.concatenate(at), np.concatenate(size)
            lengths[order], starts[order] = n, np.cumsum(n) - n
        for end, n in zip(np.cumsum(counts), counts, strict=True):
            yield _gathered(flat, starts, lengths, places[end - n : end])

    def assemble(rows: pa.Table, listed: pa.Table) -> pa.Table:
        rows, slices = rows.sort_by("row"), listed.to_pylist()
        if digests:
            by_id = pieces_of(content.value, pattern)
            out = [(len(ids), hashlib.sha256(ids).hexdigest(), hashlib.sha256(_spelled(by_id, ids)).hexdigest()) for ids in texts(rows, slices)]
            kinds = [pa.int64(), pa.string(), pa.string()]
        else:
            out, kinds = [(ids.astype("i4"),) for ids in texts(rows, slices)], [pa.list_(pa.int32())]
        values = [pa.array(v, k) for v, k in zip(zip(*out, strict=True), kinds, strict=True)]
        kept = [c for c in rows.column_names if c not in _OWN]
        return pa.Table.from_arrays([*[rows.column(c) for c in kept], *values], names=[*kept, *made])

    return assemble


def _through_words(docs: DataFrame, path: str, pattern: str, text: str, columns: Sequence[str], made: Sequence[str], digests: bool) -> DataFrame:
    content = vocabulary(docs.sparkSession, path)
    special = list(Vocabulary(content.value, pattern).special)
    cut = blocks(docs, words_of(F.col(f"`{text}`"), pattern, special), columns)
    found = word_ids(cut.select("block", F.inline("slices")), content, pattern)
    kinds = [T.LongType(), T.StringType(), T.StringType()] if digests else [T.ArrayType(T.IntegerType())]
    rows = cut.drop("slices")
    schema = T.StructType([*[f for f in rows.schema.fields if f.name not in _OWN], *map(T.StructField, made, kinds)])
    sides = rows.groupBy("block").cogroup(found.groupBy("of"))
    return sides.applyInArrow(_assembler(content, pattern, digests, made), schema).toDF(*columns, *made)


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", into: str = "ids") -> DataFrame:
    """``docs`` with the ids of its texts in ``into``."""
    return _through_words(docs, path, pattern, text, [c for c in docs.columns if c.lower() != into.lower()], [into], False)


def round_trip(docs: DataFrame, path: str, pattern: str, keep: Sequence[str], text: str = "text") -> DataFrame:
    """``keep`` plus n_tokens, ids_sha256 (ids as little-endian unsigned 32-bit
    integers) and decoded_sha256 of each row's whole text."""
    made = ["n_tokens", "ids_sha256", "decoded_sha256"]
    return _through_words(docs, path, pattern, text, [c for c in keep if c.lower() not in made], made, True)


def decode(rows: DataFrame, path: str, pattern: str, ids: str = "ids", into: str = "text") -> DataFrame:
    """``rows`` with the texts of any arrays of ids; bytes that are no UTF-8 show
    as U+FFFD, a null array gives null."""
    with open(path, "rb") as f:
        own = Vocabulary(f.read(), pattern)
    row, made = fresh([*rows.columns, into], "row", "decoded")
    counted = numbered(rows, row)
    back = joined_pieces(counted.select(row, ids), pieces(rows.sparkSession, own), row, ids, made).drop(ids)
    shown = F.when(F.col(f"`{ids}`").isNotNull(), _shown(F.col(made)))
    return counted.join(back, row).withColumn(into, shown).drop(row, made)
