"""Files, scratch tables, joins and totals; near repeats against plain Python."""

import json
import random
import time
from collections import Counter, defaultdict
from concurrent.futures import ThreadPoolExecutor

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from kinfold import constants as K
from kinfold.errors import ScratchError
from kinfold.functions import skills
from kinfold.operators import extract, near_names, scratch
from kinfold.operators.names import fresh
from kinfold.operators.prefix import ordered_totals
from kinfold.operators.projection import parse_config
from kinfold.operators.salting import heavy_join
from kinfold.plans.pipeline import write_json
from kinfold.sources import csv


def test_an_unset_folder_is_an_error_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):  # noqa: N802
            return None

    class Session:
        sparkContext = Context()  # noqa: N815
        conf = {}  # noqa: RUF012

    with pytest.raises(ScratchError):
        scratch.scratch_dir(Session())
    Context.master = "local-cluster[2,1,1024]"
    with pytest.raises(ScratchError):
        scratch.scratch_dir(Session())
    Context.master = "local[2]"
    assert scratch.scratch_dir(Session()).startswith("file:")


def test_tables_settled_inside_go_at_the_end(spark):
    with scratch.passing(spark) as keep:
        inner = scratch.settle(spark.range(5), "inner")
        kept = keep(inner.filter("id > 1"), "kept")
        path = inner.inputFiles()[0]
    assert kept.count() == 3
    with pytest.raises(Exception, match="(?i)not.*exist|no such"):
        spark.read.parquet(path).count()


def test_blocks_own_their_tables(spark):
    before = list(scratch._written)
    with scratch.passing(spark) as outer:
        with scratch.passing(spark) as keep:
            scratch.settle(spark.range(2), "gone")
            mine = keep(spark.range(3), "inner")
        assert mine.count() == 3 and len(scratch._written) == len(before) + 1
        last = outer(mine.filter("id > 0"), "outer")
        with ThreadPoolExecutor(1) as other:  # another thread's tables are not this block's
            theirs = other.submit(lambda: scratch.settle(spark.range(4), "theirs")).result()
    assert last.count() == 2 and theirs.count() == 4 and scratch._written[: len(before)] == before
    assert len(scratch._written) == len(before) + 2 and outer.kept[0] in scratch._written
    scratch.drop(spark, outer.kept)
    assert not scratch.exists(spark, outer.kept[0]) and len(scratch._written) == len(before) + 1


def test_heavy_join_equals_join(spark):
    rng = random.Random(1)
    rows = spark.createDataFrame([(rng.choice([1, 1, 1, 2, rng.randrange(9)]), i) for i in range(2000)], "k long, v long")
    one = rows.groupBy("k").agg(F.count("*").alias("c"), F.max("v").alias("most")).filter("k <> 7")
    want = sorted(map(tuple, rows.join(one, "k").select("k", "v", "c", "most").collect()))
    for total in (2000, 2000 * 10_000, 2000 * 400 * 10):
        got = heavy_join(rows, one, ["k"], "c", total)
        assert sorted(map(tuple, got.select("k", "v", "c", "most").collect())) == want
    left = heavy_join(rows, one, ["k"], "c", 2000 * 4000, "left")
    assert left.count() == 2000 and left.filter("most is null").count() == rows.filter("k = 7").count()


def test_totals_in_a_global_order(spark):
    rng = random.Random(2)
    data = [(rng.choice(["a", "B", None, "é", ""]) , i, rng.randrange(5)) for i in range(500)]
    rows = spark.createDataFrame(data, "s string, i long, n long").repartition(5)
    got = {r.i: (r.at, r.before) for r in ordered_totals(rows, [F.col("s").isNull(), F.col("s"), F.col("i")], {"at": F.lit(1), "before": F.col("n")}).collect()}
    total = 0
    for at, (_, i, n) in enumerate(sorted(data, key=lambda r: (r[0] is None, r[0] or "", r[1]))):
        assert got[i] == (at, total)
        total += n
    assert ordered_totals(rows.limit(0), [F.col("i")], {"at": F.lit(1)}).count() == 0


def test_fresh_names():
    assert fresh(["a", "_B"], "b", "c") == ["__b", "__c"] and fresh([], "x") == ["_x"]


# -- CSV -------------------------------------------------------------------------


def test_many_files_take_two_scans(spark, tmp_path):
    files = []
    for i in range(200):
        head = ["name,email", "E-mail,Full Name,zip", "email,x,x,name"][i % 3]
        cells = {0: "n{i}-{k},m{i}-{k}@x.org", 1: "m{i}-{k}@x.org,n{i}-{k},9", 2: "m{i}-{k}@x.org,,,n{i}-{k},ragged,more"}[i % 3]
        (tmp_path / f"f {i}+.csv").write_text("\n".join([head, *[cells.format(i=i, k=k) for k in range(3)]]) + "\n")
        files.append((i, str(tmp_path / f"f {i}+.csv")))
    spark.sparkContext.setJobGroup("csv", "csv")
    before = time.time()
    rows = csv.read(spark, files)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("csv")
    assert len(jobs) <= 20, "not a job a file"
    got = [(r.full_name, r.emails) for r in rows.orderBy("seq").collect()]
    assert got == [(f"n{i}-{k}", [f"m{i}-{k}@x.org"]) for i in range(200) for k in range(3)] and time.time() - before < 120
    spark.sparkContext.setJobGroup("", "")


@pytest.mark.parametrize("many", ["true", "false"])
def test_splits_keep_the_order_of_a_file(spark, tmp_path, many):
    (tmp_path / "big.csv").write_text("name\n" + "".join(f"row {k}\n" for k in range(30_000)))
    (tmp_path / "small.csv").write_text('name,skills\n"last, one","a\nb"\n' if many == "true" else "name,skills\nlast,a\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("kinfold.csv.multiLine", many)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
        rows = csv.read(spark, [(0, str(tmp_path / "big.csv")), (1, str(tmp_path / "small.csv"))])
        got = [r.full_name for r in rows.orderBy("seq").collect()]
        assert rows.select("seq").distinct().count() == 30_001
        assert got[:-1] == [f"row {k}" for k in range(30_000)] and got[-1].startswith("last")
        assert (rows.rdd.getNumPartitions() > 3) or many == "true"
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("kinfold.csv.multiLine")


def test_array_sink(spark, tmp_path):
    config = parse_config({"fields": [{"path": "id"}, {"path": "s"}], "include_confidence": False, "include_provenance": False})
    rows = spark.range(300).select("id", F.when(F.col("id") % 2 == 0, 'a"\n').alias("s")).repartition(3).orderBy(F.desc("id"))
    write_json(rows, config, str(tmp_path / "out"), array=True)
    parts = sorted((tmp_path / "out").glob("part-*"))
    found = json.loads("".join(p.read_text() for p in parts))
    assert [r["id"] for r in found] == list(range(299, -1, -1)) and found[1]["s"] == 'a"\n'
    write_json(rows.limit(0), config, str(tmp_path / "none"), array=True)
    assert json.loads("".join(p.read_text() for p in (tmp_path / "none").glob("part-*"))) == []


# -- texts -----------------------------------------------------------------------


def test_emails_are_those_of_the_plain_pattern_in_linear_time(spark):
    rng = random.Random(3)
    parts = ["a", "B1", ".", "@", "@", "-", "_", "+", " ", "co.", ".com", ".org", "é", "%", "x@y.de"]
    rows = spark.createDataFrame([("".join(rng.choices(parts, k=rng.randrange(30))),) for _ in range(5000)], "t string")
    plain = extract.every(F.col("t"), K.EMAIL)
    assert rows.filter(~plain.eqNullSafe(extract.every(F.col("t"), extract.EMAIL))).count() == 0
    assert rows.filter(F.size(plain) > 1).count() > 100
    long = spark.createDataFrame([("a" * 400_000,), ("a@" * 200_000,), ("x@" + "1." * 200_000,)], "t string")
    began = time.time()
    long.select(F.size(extract.emails(F.col("t")))).collect()
    assert time.time() - began < 10


def near(a, b):
    """Common subsequence, as 200 x length over both lengths."""
    row = [0] * (len(b) + 1)
    for x in a:
        above, row = row, [0]
        for j, y in enumerate(b):
            row.append(above[j] + 1 if x == y else max(above[j + 1], row[-1]))
    return 200 * row[-1] / (len(a) + len(b)) if a or b else 100


def test_fuzzy_dedup_equals_plain_python(spark, small):
    con = duckdb.connect()
    names = con.execute(
        f"SELECT l_orderkey, p_name || ' ' || p_brand FROM '{small}/lineitem.parquet' JOIN '{small}/part.parquet' ON p_partkey = l_partkey ORDER BY l_orderkey, l_linenumber, l_partkey"
    ).fetchall()
    orders = defaultdict(list)
    for order, name in names:
        orders[order].append(name)
    got = {r.l_orderkey: (r.n_raw, r.kept) for r in entry.queries()["fuzzy_dedup"](spark, small).collect()}
    dropped = 0
    for order, raw in orders.items():
        kept = []
        for x in raw:
            if not any(near(x.lower(), k.lower()) >= 90 for k in kept):
                kept.append(x)
        dropped += len(raw) - len(kept)
        assert got.pop(order) == (len(raw), "|".join(kept))
    assert not got and dropped > 50


def test_common_length_is_that_of_the_table(spark):
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abc日🙂") for _ in range(n))
    pairs = [(word(rng.choice([0, 1, 5, 30])), word(rng.choice([0, 2, 9, 40]))) for _ in range(60)]
    pairs += [(word(n), word(m)) for n, m in ((61, 62), (62, 62), (63, 20), (124, 130), (125, 7), (200, 190))]
    pairs += [("a" * 62, "a" * 62), ("a" * 130, "a" * 130), ("ab" * 70, "ba" * 70)]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i long, a string, b string")
    got = {r.i: r.n for r in rows.select("i", skills.common_length(F.col("a"), F.col("b")).alias("n")).collect()}
    assert got == {i: round(near(a, b) * (len(a) + len(b)) / 200) for i, (a, b) in enumerate(pairs)}


def plain_kept(rows, ratio):
    """Greedy in order, group by group."""
    groups = defaultdict(list)
    for g, o, name in sorted((r for r in rows if r[2] is not None), key=lambda r: (r[0] is None, r[0], r[1], r[2].encode())):
        if not any(near(name.lower(), k.lower()) >= ratio or name.lower() == k.lower() for _, k in groups[g]):
            groups[g].append((o, name))
    return {(g, o, n) for g, kept in groups.items() for o, n in kept}


@pytest.mark.parametrize("ratio", [90.0, 75.0, 55.0])
def test_near_rows_equal_greedy_order(spark, ratio):
    rng = random.Random(int(ratio))
    roots = ["react native", "kubernetes", "machine learning", "sql", "go", "日本語処理", "c", "", "aaaaaaaaaa"]

    def name():
        s = list(rng.choice(roots))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            at = rng.randrange(len(s) + 1)
            s[at : at + rng.choice([0, 1])] = rng.choice(["", "a", "x", " ", "S"])
        return "".join(s)

    rows = [(rng.choice([0, 0, 0, 1, 2, None]), i, rng.choice([None, *[name()] * 9])) for i in range(400)]
    rows += [(7, i, "n" + "b" * i) for i in range(40)] + [(8, 0, "same name here"), (8, 0, "same name hers")]  # a chain, and a tie
    got = near_names.without_near_rows(spark.createDataFrame(rows, "g long, o long, name string"), "g", "o", "name", ratio)
    assert {tuple(r) for r in got.collect()} == plain_kept(rows, ratio) and got.count() == got.distinct().count()


def name_chain(rng):
    """Rows whose names make one class of 90, one of 12 and some of one, in groups of which one has many rows and one is null."""
    pool = ["n" + "b" * i for i in range(10, 100)] + [f"same names {i:02d}" for i in range(12)] + [f"{c * 9}" for c in "cdef"]
    return [(rng.choice([0, 1, 1, 2, 3, None]), rng.randrange(50), rng.choice(pool)) for _ in range(300)] + [(4, i, rng.choice(pool)) for i in range(200)]


@pytest.mark.parametrize("heavy", [False, True])
@pytest.mark.parametrize("least", [10, 90])
def test_kept_groups_equal_greedy_order(spark, heavy, least):
    rows = [r for r in name_chain(random.Random(5)) if len(r[2]) < least]
    df = spark.createDataFrame(rows, "g long, o long, name string").filter("g is null or g <> 3 or o > 0")
    found, near, large = near_names.classed(df, "name")
    hashes = [r[0] for r in df.filter("g is null or g in (1, 4)").select(F.xxhash64("g")).distinct().collect()] if heavy else []
    got = near_names.kept_groups(found, "g", "o", "name", near, large, hashes).collect()
    assert large == (least > 64 + 11)
    whole = [tuple(r) for r in df.collect()]
    assert {r.g: r.n for r in got} == Counter(r[0] for r in whole) and len(got) == len({r[0] for r in whole})
    assert {(r.g, x.o, x.name) for r in got for x in r.kept} == plain_kept(whole, 90.0)
    assert all(list(r.kept) == sorted(r.kept) for r in got)


def test_heavy_groups_are_found(spark, monkeypatch):
    monkeypatch.setattr(near_names, "LEAST", 100)
    rows = spark.range(40_000).select(F.when(F.col("id") < 200, F.lit("hot")).when(F.col("id") > 500, F.col("id").cast("string")).alias("g"))
    assert set(near_names.heavy_groups(rows, "g")) == {r[0] for r in rows.filter("id < 300").select(F.xxhash64("g")).distinct().collect()}
    assert near_names.heavy_groups(rows.limit(0), "g") == []


def test_fuzzy_dedup_moves_rows_once_or_twice(spark, tmp_path):
    """Not once more for each name that is near theirs."""
    name = F.format_string("long part name of group %02d", F.col("id") % 40)
    spark.range(200).select(F.col("id").alias("p_partkey"), name.alias("p_name"), F.lit("Brand").alias("p_brand")).write.parquet(f"{tmp_path}/part.parquet")
    spark.range(40_000).select(F.expr("id % 15013").alias("l_orderkey"), F.expr("id % 199").alias("l_partkey"), F.expr("cast(id % 7 as int)").alias("l_linenumber")).write.parquet(f"{tmp_path}/lineitem.parquet")
    moved = lambda: spark._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()
    before, small = moved(), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if the tables were large
    try:
        assert entry.queries()["fuzzy_dedup"](spark, str(tmp_path)).agg(F.sum("n_raw")).first()[0] == 40_000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", small)
    time.sleep(1)
    assert 0 < moved() - before < 4_000_000


def test_pairs_are_compared_once(spark):
    """Names in many groups are still a row each, and only near ones are linked."""
    names = spark.createDataFrame([(i, f"name number {i:03d} of many") for i in range(60)] + [(60, "else"), (61, "")], "id long, name string")
    pairs = {tuple(r) for r in near_names.near_pairs(names).collect()}
    want = {(a, b) for a in range(60) for b in range(a + 1, 60) if near(f"{a:03d}", f"{b:03d}") and near(f"name number {a:03d} of many", f"name number {b:03d} of many") >= 90}
    assert pairs == want and near_names.near_pairs(names.limit(0)).count() == 0


def test_canonical_rows_equal_arrays(spark):
    rng = random.Random(4)
    pool = ["JS", "javascript ", "py", "Go", "go", "GOLANG", " ", None, "Rust", "rust", "x y"]
    data = [(g, i, rng.choice(pool)) for g in range(40) for i in range(rng.randrange(1, 8))]
    rows = spark.createDataFrame(data, "g long, i long, raw string")
    got = {r.g: r.skills for r in skills.canonical_rows(rows, "g", F.col("i"), F.col("raw")).collect()}
    arrays = rows.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("i", "raw"))).alias("x"))
    want = arrays.select("g", skills.canonicalize_skills(F.transform("x", lambda x: x["raw"]), fuzzy=False).alias("s")).collect()
    assert got == {r.g: r.s for r in want if r.s} and Counter(map(len, got.values()))[1] > 0
