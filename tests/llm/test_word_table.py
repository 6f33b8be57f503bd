"""Encoding through distinct words against the tokenizers library."""

import hashlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kinfold.llm import packing, queries, word_table

PATH = P.path("byte_bpe_50k.json")
TEXTS = [
    None, "", " ", "\n \t", "a", "don't  stop\n\n now", "x" * 5000, "日本語 🙂 é", "<|endoftext|> a<|endoftext|>", "1234 ab12", "a \x1c b\x85c",
    "  <|endoftext|>  \n<|endoftext|><|endoftext|>!<|endo", "!<|endoftext|>\n", "we'll 'S we're'd", "　 x\xa0 y", "a\r\n\r\nb  ", "🙂a" * 3000, "é ٣٤ ²",
    "don't  stop\n\n now", "the " * 20000,
]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def frame(spark, texts):
    return spark.createDataFrame([(i, t, i % 3, "x") for i, t in enumerate(texts)], "doc_id long, text string, _block int, `odd.name` string")


def ids(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def digests(tokenizer, text):
    own = ids(tokenizer, text)
    back = tokenizer.decode(own, skip_special_tokens=False)
    return len(own), hashlib.sha256(np.array(own, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()


def test_encode_and_decode_equal_library(spark, tokenizer):
    docs = frame(spark, TEXTS).repartition(3)
    out = word_table.encode(docs, PATH, P.PATTERN)
    assert out.columns == [*docs.columns, "ids"]
    got = {r.doc_id: r for r in out.collect()}
    assert {i: list(r.ids) for i, r in got.items()} == {i: ids(tokenizer, t) for i, t in enumerate(TEXTS)}
    assert all(got[i].text == t and got[i]["odd.name"] == "x" and got[i]._block == i % 3 for i, t in enumerate(TEXTS))
    back = word_table.decode(out.drop("text"), PATH, P.PATTERN)
    assert {r.doc_id: r.text for r in back.collect()} == {i: t or "" for i, t in enumerate(TEXTS)}


def test_decode_any_ids(spark, tokenizer):
    rows = spark.createDataFrame([(1, [50256, 447, 64]), (1, [447]), (2, None), (3, [])], "id long, ids array<int>")
    got = word_table.decode(rows, PATH, P.PATTERN).collect()
    want = {(r.id, None if r.ids is None else tuple(r.ids)): None if r.ids is None else tokenizer.decode(r.ids, skip_special_tokens=False) for r in rows.collect()}
    assert {(r.id, None if r.ids is None else tuple(r.ids)): r.text for r in got} == want


def test_words_join_to_the_text(spark):
    rows = frame(spark, TEXTS).select("text", word_table.words_of(F.col("text"), P.PATTERN, ["<|endoftext|>"]).alias("w"))
    for r in rows.collect():
        assert "".join(r.w) == (r.text or "")


def test_small_blocks_and_empty_tables(spark, tokenizer, monkeypatch):
    monkeypatch.setattr(word_table, "BLOCK_WORDS", 4)
    docs = frame(spark, TEXTS[:19]).repartition(2)
    got = word_table.round_trip(docs, PATH, P.PATTERN, keep=["doc_id", "odd.name"])
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got.collect()} == {i: digests(tokenizer, t) for i, t in enumerate(TEXTS[:19])}
    for few in (docs.limit(0), docs.filter("coalesce(text, '') = ''")):
        assert word_table.round_trip(few, PATH, P.PATTERN, keep=["doc_id"]).count() == few.count()
    named = docs.select(F.col("doc_id").alias("n_tokens"), "text")
    assert word_table.round_trip(named, PATH, P.PATTERN, keep=["n_tokens"]).columns == ["n_tokens", "ids_sha256", "decoded_sha256"]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 70000), max_size=50), st.lists(st.sampled_from("abcdefg"), max_size=30))
def test_packed_places(numbers, words):
    assert packing.unpack(packing.pack(np.array(numbers, np.int64)), len(numbers)).tolist() == numbers
    assert packing.unpack_strings(packing.pack_strings(pa.array(words, pa.binary()).slice(1))).to_pylist() == [w.encode() for w in words[1:]]
    coded = pa.array(words, pa.string()).dictionary_encode()
    ranked, distinct = word_table._ranked(coded.indices.to_numpy(), coded.dictionary.cast(pa.binary()))
    back = word_table._unranked(packing.unpack(packing.pack(ranked), len(words)).astype(np.int64), len(distinct))
    assert [distinct[int(i)].as_py().decode() for i in back] == words


def test_query_equals_library_on_all_documents(spark, small, tokenizer):
    texts = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op11_word_table(spark, small).collect()}
    assert got == {r.doc_id: digests(tokenizer, r.text) for r in texts}
