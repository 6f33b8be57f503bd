"""Byte-level BPE encoding and decoding by prefix dynamic programming.

Per task one ``PrefixBpe`` (see ``prefix_bpe``) works on Arrow batches of whole
texts; nothing is shuffled.  The vocabulary file is read on the driver and
broadcast: its size is that of one vocabulary, whatever the corpus.

Defined results: a null text counts as empty and gives no ids; repeated rows
are encoded each; other columns, of any name, pass through ``encode`` untouched
except for the column named by ``into``, which is replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.operators.names import fresh

from .prefix_bpe import PrefixBpe, ranks_of_tiktoken


@lru_cache(maxsize=2)
def coder(content: bytes, pattern: str) -> PrefixBpe:
    """One coder a worker and vocabulary; its caches outlive a task."""
    return PrefixBpe(ranks_of_tiktoken(content), pattern)


def vocabulary(spark: SparkSession, path: str):
    """Broadcast bytes of a vocabulary file on the driver's side."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encoder(spark: SparkSession, path: str, pattern: str, digests: bool = False):
    """A Column function: text -> ids array<int>; with ``digests`` instead
    struct(n_tokens, ids_sha256, decoded_sha256) from encoding and decoding."""
    shared = vocabulary(spark, path)

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = coder(shared.value, pattern)
        for texts in batches:
            yield pd.Series([np.frombuffer(bpe.encode_packed(t or ""), "<u4").astype("i4") for t in texts], dtype=object)

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def round_trip(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        bpe = coder(shared.value, pattern)
        for texts in batches:
            rows = []
            for t in texts:
                packed = bpe.encode_packed(t or "")
                back = bpe.decode_bytes(packed)
                rows.append((len(packed) // 4, hashlib.sha256(packed).hexdigest(), hashlib.sha256(back).hexdigest()))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return round_trip if digests else ids


def decoder(spark: SparkSession, path: str, pattern: str):
    """A Column function: ids array<int> -> text; bytes that are no UTF-8 show
    as U+FFFD, a null array gives null."""
    shared = vocabulary(spark, path)

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bytes_of = coder(shared.value, pattern).bytes_of
        for ids in batches:
            yield pd.Series(
                [None if x is None else b"".join(bytes_of[int(i)] for i in x).decode("utf-8", "replace") for x in ids], dtype=object
            )

    return text


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", into: str = "ids") -> DataFrame:
    """``docs`` with the ids of its texts in ``into``."""
    return docs.withColumn(into, encoder(docs.sparkSession, path, pattern)(F.col(text)))


def decode(docs: DataFrame, path: str, pattern: str, ids: str = "ids", into: str = "text") -> DataFrame:
    """``docs`` with the texts of its ids in ``into``."""
    return docs.withColumn(into, decoder(docs.sparkSession, path, pattern)(F.col(ids)))


def round_trip(docs: DataFrame, path: str, pattern: str, keep: list[str | Column], text: str = "text") -> DataFrame:
    """``keep`` plus n_tokens, ids_sha256 (ids as little-endian unsigned 32-bit
    integers) and decoded_sha256 of each row's text, encoded and decoded; a kept
    column named like one of these gives way to it."""
    both = encoder(docs.sparkSession, path, pattern, digests=True)
    (made,) = fresh(docs.columns, "bpe")
    rows = docs.select(*keep, both(F.col(text)).alias(made))
    kept = [c for c in rows.columns if c.lower() not in (made, "n_tokens", "ids_sha256", "decoded_sha256")]
    return rows.select(*kept, f"{made}.*")
