"""Multi-line CSV in splits against one-task reading."""

import csv as plain
import io
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinfold.errors import MalformedCsv, SourceError
from kinfold.plans.pipeline import read_folder
from kinfold.sources import csv, csv_splits

LINE = st.text(alphabet=['"', ",", "a", " "], max_size=12)


def automaton(line, inside):
    """The state behind a line, one character at a time."""
    state = "quoted" if inside else "start"
    for ch in line:
        if state == "start":
            state = "quoted" if ch == '"' else "start" if ch == "," else "plain"
        elif state == "plain":
            state = "start" if ch == "," else "plain"
        elif state == "quoted":
            state = "closing" if ch == '"' else "quoted"
        else:
            state = "quoted" if ch == '"' else "start" if ch == "," else "plain"
    return state == "quoted"


@settings(max_examples=400, deadline=None)
@given(LINE, st.booleans())
def test_states_of_lines(line, inside):
    assert csv_splits.ends_inside(line, inside) == automaton(line, inside)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.lists(LINE, min_size=1, max_size=4), min_size=1, max_size=8))
def test_states_of_splits(spark, splits):
    rows = [("f", i, automaton_all(s, False), automaton_all(s, True)) for i, s in enumerate(splits)]
    maps = spark.createDataFrame(rows, "path string, start long, from_outside boolean, from_inside boolean")
    want, inside = {}, False
    for i, s in enumerate(splits):
        want[i] = inside
        inside = automaton_all(s, inside)
    assert {r.start: r.inside for r in csv_splits.split_states(maps).collect()} == want


def automaton_all(lines, inside):
    for line in lines:
        inside = automaton(line, inside)
    return inside


@pytest.fixture
def small_splits(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
    spark.conf.set("spark.sql.files.openCostInBytes", old[1])


def written(path, rows, end="\n"):
    out = io.StringIO(newline="")
    plain.writer(out, lineterminator=end).writerows(rows)
    path.write_bytes(out.getvalue().encode())
    return str(path)


def cells(seed, n):
    rng = random.Random(seed)
    part = ["x", "é", '"', ",", "\n", "\n\n", '",', '""', " ", "line\nbreak", "日本"]
    text = lambda: "a" + "".join(rng.choice(part) for _ in range(rng.choice([0, 1, 3, 9, 60]))) + "b"
    return [[text() if k else f"n{i}", text(), text()] for i in range(n) for k in (rng.randrange(3),)]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_large_file_equals_one_task_reading(spark, tmp_path, small_splits, end):
    rows = cells(1, 900)
    rows[200][2] = "a" + 'long ", \n' * 2500 + "b"  # over several splits
    rows[-1][2] = "last\n"
    path = written(tmp_path / "one.csv", [["name", "headline", "company"], *rows], end)
    got = csv.read(spark, [(0, path)])
    found = [(r.full_name, r.headline, r.current_company) for r in got.orderBy("seq").collect()]
    assert found == [tuple(c.strip() for c in r) for r in rows]
    assert got.select("seq").distinct().count() == len(rows) and got.rdd.getNumPartitions() > 10
    spark_own = spark.read.csv(path, header=True, multiLine=True, escape='"').count()
    assert spark_own == len(found)


def test_many_files_quotes_and_blank_lines(spark, tmp_path, small_splits):
    files = []
    for i in range(12):
        body = [[f"n{i}-{k}", f"m{k}@x.org", 'say "hi"\nthere' if k % 7 == 0 else "t"] for k in range(60)]
        files.append((i, written(tmp_path / f"f {i}+.csv", [["E-mail"] if i == 3 else ["name", "email", "title"], *([["a@x.org"]] if i == 3 else body)])))
    (tmp_path / "blank.csv").write_text('\ufeff\n  \n"full\nname",email,Name\n\nx,y@x.org,"z\n\n1"\n\n')
    (tmp_path / "mark.csv").write_text('\ufeff"name",title\nq,r\n')
    (tmp_path / "open.csv").write_text('name,title\na,"never closed\nb,c\n')
    (tmp_path / "stray.csv").write_text('name,title\n5" pipe,x"y"\n"a"b,"c"\n')
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "head.csv").write_text("name")
    files += [(100 + i, str(tmp_path / n)) for i, n in enumerate(["blank.csv", "open.csv", "stray.csv", "empty.csv", "head.csv", "mark.csv"])]
    rows = csv.read(spark, files).withColumn("file", F.shiftright("seq", csv.ROWS)).orderBy("seq").collect()
    by = lambda n: [r for r in rows if r.file == n]
    assert [r.full_name for r in by(5)] == [f"n5-{k}" for k in range(60)] and by(5)[7].headline == 'say "hi"\nthere'
    assert [r.emails for r in by(3)] == [["a@x.org"]] and by(5)[0].source_file == "f 5+.csv"
    assert [(r.full_name, r.emails) for r in by(100)] == [("z\n\n1", ["y@x.org"])]
    assert [r.full_name for r in by(101)] == ["a"] and "never closed" in by(101)[0].headline
    assert [r.full_name for r in by(102)][0] == '5" pipe' and len(by(102)) == 2
    assert not by(103) and not by(104) and [r.full_name for r in by(105)] == ["q"]


def test_errors(spark, tmp_path):
    (tmp_path / "odd.csv").write_text("shoe,size\n1,2\n")
    (tmp_path / "good.csv").write_text("name\nx\n")
    with pytest.raises(MalformedCsv, match="odd.csv"):
        csv.read(spark, [(0, str(tmp_path / "odd.csv")), (1, str(tmp_path / "good.csv"))])
    with pytest.raises(SourceError):
        csv.read(spark, [(0, str(tmp_path / "absent.csv"))])
    (tmp_path / "none.csv").write_text("")
    assert csv.read(spark, [(0, str(tmp_path / "none.csv"))]) is None


def test_only_crossing_records_are_shuffled(spark, tmp_path, small_splits):
    path = written(tmp_path / "one.csv", [["name", "title"], *[[f"n{i}", "t\nu"] for i in range(3000)]])
    maps = csv_splits.split_maps(csv_splits.lines(spark, [path]), True)
    splits = csv_splits.split_states(maps)
    lines = csv_splits.lines(spark, [path])
    cut = csv_splits._cut_records(lines.join(F.broadcast(splits.select("path", "start", "inside")), ["path", "start"]), True)
    counts = {r.cut: r["count"] for r in cut.groupBy("cut").count().collect()}
    n = splits.count()
    assert n > 10 and counts[csv_splits.COMPLETE] > 2900 and sum(c for k, c in counts.items() if k) <= 2 * n


def test_a_folder_with_broken_files(spark, tmp_path):
    (tmp_path / "a b").mkdir()
    for i in range(40):
        (tmp_path / "a b" / f"f{i:02d}+.CSV").write_text(f'name,title\nn{i},"t\nu"\n')
    (tmp_path / "odd.csv").write_text("shoe\n1\n")
    (tmp_path / "none.csv").write_text("")
    (tmp_path / "x.docx").write_text("z")
    (tmp_path / "cv.pdf").write_bytes(b"%PDF-1.4\n1 0 obj << >> stream\nBT (Ada Byron) Tj T* (ada@x.org) Tj ET\nendstream endobj\n%%EOF")
    (tmp_path / "broken.pdf").write_bytes(b"no pdf")
    records, odd = read_folder(spark, str(tmp_path))
    rows = records.orderBy("seq").collect()
    assert [r.full_name for r in rows if r.source_type == "csv"] == [f"n{i}" for i in range(40)]
    assert [(r.source_file, r.emails) for r in rows if r.source_type == "pdf"] == [("cv.pdf", ["ada@x.org"])]
    assert {r.path.rsplit("/", 1)[1]: r.reason for r in odd.collect()} == {
        "odd.csv": "no recognizable columns", "x.docx": "unknown kind of source", "broken.pdf": "no text",
    }
