"""Pseudonyms: hard texts, finds at edges, and dates as a permutation."""

import datetime
import time

from pyspark.sql import functions as F

from kinfold.llm import pseudonyms


def test_long_and_repetitive_texts_do_not_crash(spark):
    texts = [
        "x@" + "a." * 100_000 + "com", "a@b." * 30_000, "+44 " * 3000, "+4" + " 4" * 2000, "44 " * 2000, "4111 1111 1111 1111 " * 200,
        "DE89 " * 20_000, "AB12" * 30_000, "1.1." * 30_000, "a.b'" * 30_000, "ü" * 100_000 + "@x.com", "(" * 100_000, "12/12/" * 20_000,
    ]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    began = time.time()
    got = {r["doc_id"]: r for r in pseudonyms.pseudonymise(rows, "k").select("doc_id", F.length("text").alias("n"), "n_pii").collect()}
    assert len(got) == len(texts) and time.time() - began < 120
    assert got[5]["n_pii"] == 200 and got[0]["n_pii"] == got[11]["n_pii"] == 0


def test_edges_of_finds_and_clashing_columns(spark):
    cases = {
        "+44 20 7946 0958_x": "+44 20 7946 0958", "write jürgen@example.com": "jürgen@example.com", "o'brien@example.com!": "o'brien@example.com",
        "x" * 70 + "@example.com": "x" * 70 + "@example.com", "card 4111111111111111-please": "4111111111111111",
        "+44 20 7946 0958 2024": "+44 20 7946 0958", "(415) 555-0123_x": "(415) 555-0123", "a.b@c.example.com. Next": "a.b@c.example.com",
        "78051120 and 078051120": None, "+1 155 555 0123": "+1 155 555 0123", "+1 (017) 555-7713": "+1 (017) 555-7713", "é" * 300 + "@example.com": None,
    }
    rows = spark.createDataFrame([(i, t, "k") for i, t in enumerate(cases)], "doc_id long, text string, _old string")
    got = {r["doc_id"]: r for r in pseudonyms.pseudonymise(rows, "k").collect()}
    for i, (text, old) in enumerate(cases.items()):
        assert [f["old"] for f in got[i]["finds"]] == ([old] if old else []), text
        assert got[i]["_old"] == "k"
        if old:
            assert old not in got[i]["text"] and len(got[i]["text"].replace(got[i]["finds"][0]["new"], "")) == len(text) - len(old)


def test_dates_are_permuted_in_each_spelling(spark):
    """All days of ten years and of leap Februaries: spellings agree, none collide, all days are back in range."""
    first = datetime.date(1800, 1, 1)
    day = F.date_add(F.lit(first), F.col("id").cast("int"))
    days = spark.range(146_097).select(day.alias("d")).filter("year(d) % 40 = 0 or (month(d) = 2 and day(d) = 29)")
    shown = {"iso": "yyyy-MM-dd", "dot": "dd.MM.yyyy", "us": "MM/dd/yyyy", "eu": "dd/MM/yyyy"}
    parts = [F.struct(F.lit(k).alias("k"), F.date_format("d", f).alias("x")) for k, f in shown.items()]
    rows = days.repartition(4).select("d", F.explode(F.array(*parts)).alias("s")).select("d", "s.*").filter("k <> 'eu' or day(d) > 12")
    valid, new = pseudonyms._date("key", F.col("x"))
    rows = rows.select("d", "k", "x", valid.alias("valid"), new.alias("new")).toPandas()
    assert rows["valid"].all()
    assert rows.groupby("k")["new"].nunique().to_dict() == rows.groupby("k")["x"].nunique().to_dict()
    slashes = rows[rows["k"].isin(["us", "eu"])]
    assert slashes["new"].nunique() == len(slashes)
    for k, f in {"iso": "%Y-%m-%d", "dot": "%d.%m.%Y", "us": "%m/%d/%Y", "eu": "%d/%m/%Y"}.items():
        mine = rows[rows["k"] == k]
        rows.loc[mine.index, "date"] = [datetime.datetime.strptime(x, f).date() for x in mine["new"]]
    assert (rows.groupby("d")["date"].nunique() == 1).all()


def test_late_days_count_up_without_gaps(spark):
    day = F.date_add(F.lit(datetime.date(1800, 1, 1)), F.col("id").cast("int"))
    days = spark.range(146_097).select(day.alias("d")).filter("day(d) > 12")
    rows = days.select("d", pseudonyms._late_days(F.col("d")).alias("n"))
    rows = rows.withColumn("back", pseudonyms._late_date(F.col("n")))
    r = rows.agg(F.count("*"), F.countDistinct("n"), F.min("n"), F.max("n"), F.sum((F.col("back") != F.col("d")).cast("int"))).first()
    assert tuple(r) == (88_497, 88_497, 0, 88_496, 0)


def test_phones_inside_and_outside_of_the_plan_never_meet(spark):
    """Numbers with +1 whose exchange starts with 0 or 1 stay outside of the plan."""
    numbers = [f"+1 23{i % 10} {j}55 {i:04d}" for i in range(150) for j in range(10)]
    rows = spark.createDataFrame(list(enumerate(numbers)), "doc_id long, x string").repartition(4)
    valid, new = pseudonyms._phone("k", F.col("x"))
    got = rows.select("doc_id", valid.alias("valid"), new.alias("new")).toPandas().set_index("doc_id")
    assert got["valid"].all() and got["new"].nunique() == len(numbers)
    for i, x in enumerate(numbers):
        assert (got["new"][i][7] in "01") == (x[7] in "01")
