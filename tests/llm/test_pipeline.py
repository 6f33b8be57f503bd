"""Stages of the pipeline on empty tables, nulls in every column, and what they leave behind."""

import hashlib
import os

import pytest

import corpus_pipeline
from kinfold.operators import scratch

SMALL = "/root/testdata/sf0.001"
ROWS = "doc_id long, text string, lang string, source string, n_chars long"


def test_empty_tables_and_nulls_everywhere(spark):
    rows = [(1, None, None, None, None), (None, None, "en", "a", 0), (2, "", "en", None, 0), (3, " \n", None, "a", 2), (4, "one two", "en", "a", 7)]
    kept = {"toxicity": 5, "exact dedup": 2, "near dedup": 5, "mixing": None, "bpe": 5}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.createDataFrame([], ROWS), SMALL).count() == 0, name
        out = stage(spark, spark.createDataFrame(rows, ROWS), SMALL).collect()
        assert kept[name] is None or len(out) == kept[name], (name, out)
        if name == "exact dedup":
            assert sorted(r.doc_id for r in out) == [3, 4], "of blank texts the longest stays"
        if name == "mixing":
            assert 4 in [r.doc_id for r in out]


@pytest.mark.parametrize("folder", ["my dir", "relative"])
def test_lazy_results_and_interleaved_stages(spark, tmp_path, monkeypatch, folder):
    """Results that are read late, in a folder with a blank or a relative one."""
    (tmp_path / folder).mkdir()
    where = f"file://{tmp_path}/{folder}" if folder == "my dir" else os.path.relpath(tmp_path / folder)
    monkeypatch.setattr(scratch, "scratch_dir", lambda spark: where)
    docs, stages = spark.read.parquet(f"{SMALL}/documents.parquet"), dict(corpus_pipeline.STAGES)
    half = docs.filter("doc_id % 2 = 0")
    for name in ("exact dedup", "mixing", "near dedup")[: 3 if folder == "my dir" else 2]:
        before = len(scratch._written)
        a = stages[name](spark, docs, SMALL)
        b = stages[name](spark, half, SMALL)
        assert len(scratch._written) == before + 4, "the numbered rows and the decisions of each"
        assert b.count() > 0 and a.count() > b.count(), name
    assert len(os.listdir(tmp_path / folder / "kinfold")) == len([t for t in scratch._written if t.startswith(where)])


def test_two_runs_beside_each_other(spark, small):
    a = corpus_pipeline.run(spark, small)
    before = len(scratch._written)
    b = corpus_pipeline.run(spark, small)
    assert len(scratch._written) <= before + 3, "a run leaves what its result reads: the last stage's table"
    assert b.count() > 0 and sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_very_long_texts_and_other_columns(spark):
    long = " ".join(f"w{i % 977}x{i}" for i in range(120_000))
    rows = [(1, long, "en", "a", len(long)), (2, long + " end", "en", "b", 0), (3, "short text", "en", "a", 10)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], ROWS + ", _row string, copies int")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL)
        if name == "bpe":
            assert {r.doc_id: r.decoded_sha256 for r in out.collect()} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t, *_ in rows}
        else:
            assert out.columns == corpus_pipeline.COLUMNS
            assert {r.text for r in out.collect()} <= {r[1] for r in rows}, name
