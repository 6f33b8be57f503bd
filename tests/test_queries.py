"""Registered queries against their SQL on the smallest tables."""

import os
import re
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry

ROOT = os.path.dirname(os.path.abspath(entry.__file__))


@pytest.fixture(scope="module")
def views(small):
    con = duckdb.connect()
    for name in os.listdir(small):
        path = f"{small}/{name}"
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def rows(pdf):
    pdf = pdf[sorted(pdf.columns)]
    return sorted(map(repr, pdf.astype(object).where(pdf.notna(), None).values.tolist()))


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_sql_gives_the_same(spark, small, views, name):
    got, want = entry.queries()[name](spark, small).toPandas(), views.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", ["entity_profiles", "resume_parse"])
def test_others_run(spark, small, name):
    assert entry.queries()[name](spark, small).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_entry_without_the_corpus_part():
    hide = "import sys; sys.modules['kinfold.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert q and not [n for n in q if n.startswith('op') or n == 'pipeline']; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", hide], cwd=ROOT, check=True, timeout=120)


def test_extraction_stays_in_the_jvm(spark, small):
    for name in ("resume_parse", "csv_records", "canonical_dedup", "fuzzy_dedup"):
        plan = entry.queries()[name](spark, small)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("EvalPython|MapInPandas|MapInArrow|FlatMapGroups", plan)


def test_normalize_phones_keeps_numbers_abroad(spark, tmp_path):
    texts = ["call +44 20 7946 0958 or (415) 555-2671", "+49 30 1234 5678", "+83 30 1234 5678", None, "no number"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = entry.queries()["normalize_phones"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [(0, "+14155552671"), (0, "+442079460958"), (1, "+493012345678")]
