"""Fill-in-middle examples against string slicing."""

import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinfold.llm import fill_in_middle as fim
from kinfold.llm import queries

TEXTS = [
    None, "", "\n", "one line", "a\nb\nc\n", "a\n\n\nb", "é\n日本\n🙂🙂\nend", "has <P> inside\nx\n", "< P>\n<S\n>M>\n<", "x\n" * 3000, "\r\n \x0b\n",
    "last<M>", "a\nb\nc\n",
]


def plain(text, doc_id, percent=100, spm=50):
    """The definition, by slices of strings."""
    text, digest = text or "", hashlib.sha256(f"7:{doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= percent:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm:
        return n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def sha(text):
    return hashlib.sha256((text or "").encode()).hexdigest()


def frame(spark, texts):
    rows = [(i, t, "kept", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, _fim string, form int")


def test_outputs_and_spans(spark):
    for percent, spm in ((100, 50), (30, 0), (100, 100)):
        layout = fim.Layout(percent, spm)
        out = fim.restore(fim.transform(frame(spark, TEXTS * 4), 7, layout), layout)
        assert out.columns == ["doc_id", "text", "_fim", "n", "form", "prefix_chars", "middle_chars", "spans", "output", "restored"]
        for r in out.collect():
            assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain(r.text, r.doc_id, percent, spm)
            assert r.restored == (r.text or "") and r._fim == "kept"
            buffers = [(r.text or "").encode(), *(s.encode() for s in fim.SENTINELS)]
            assert b"".join(buffers[s.buffer][s.start : s.end] for s in r.spans).decode() == r.output


def test_digests_are_those_of_the_texts(spark):
    texts = TEXTS * 5
    got = {r.doc_id: r for r in fim.digested(frame(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        n, form, pre, mid, output = plain(t, i)
        assert got[i].asDict() == {"doc_id": i, "n": n, "form": form, "prefix_chars": pre, "middle_chars": mid, "output_sha256": sha(output), "restored_sha256": sha(t)}


def test_null_ids_repeats_and_empty_tables(spark):
    rows = spark.createDataFrame([(None, "a\nb\n"), (None, "a\nb\n"), (1, "a\nb\n"), (1, "a\nb\n")], "doc_id long, text string")
    got = fim.digested(rows).collect()
    assert len(got) == 4 and len({tuple(r) for r in got}) == 2
    assert {r.restored_sha256 for r in got} == {sha("a\nb\n")}
    assert fim.digested(rows.limit(0)).count() == 0 and fim.transform(rows.limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "<", "P>", "<P", "S", ">", "\n", "é", "🙂"]), max_size=25), st.lists(st.integers(0, 2**32 - 1), min_size=4, max_size=4))
def test_round_trip(parts, h):
    text, layout = "".join(parts).encode(), fim.Layout()
    n, form, table = layout.build(text, h)
    back = layout.rebuild(table.to_bytes(), form)
    assert back.to_bytes() == text and table.sha256() == hashlib.sha256(table.to_bytes()).hexdigest()
    assert n == len(re.findall(rb"[^\n]*\n|[^\n]+", text))


def test_query_counts_all_documents(spark, small):
    texts = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    got = queries.op13_fill_in_middle(spark, small)
    want = {r.doc_id: plain(r.text, r.doc_id) for r in texts.collect()}
    assert {r.doc_id: (r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256) for r in got.collect()} == {i: (*w[:4], sha(w[4])) for i, w in want.items()}
    both = got.join(texts, "doc_id").filter(F.col("restored_sha256") != F.sha2(F.coalesce("text", F.lit("")), 256))
    assert both.count() == 0
