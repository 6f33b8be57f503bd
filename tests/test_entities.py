"""Sources, extraction, identity, merging, confidence, projection, validation."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from kinfold import cli, queries
from kinfold import constants as K
from kinfold.errors import ConfigError, MalformedCsv, ProjectionError, SourceError, ValidationError
from kinfold.operators import audit, components, confidence, extract, identity, merge, projection, validate
from kinfold.plans.pipeline import normalize, profiles, read_sources, transform
from kinfold.schema import PARSED, ddl
from kinfold.sources import csv, manifest
from kinfold.streaming.incremental import merge_stream, windowed_counts

RESUME = """ADA BYRON
ada@engine.example | +1 (415) 555-0142 | London, UK
https://linkedin.com/in/ada-byron
https://ada.example/notes
SUMMARY:
Analyst with 12+ years of experience in
computing machines.
--- Skills ---
Python, reactjs | C
Kubernetes; Docker
EXPERIENCE
- kept from before
Lead Analyst | Engine Works | Jan 2019 - Present
- Wrote the first notes
- Taught machines
wrapped line
Programmer, Looms 2015-2018
- Cards
EDUCATION
B.Sc Mathematics
Home College | 2014
Master of Numbers 2016
"""

TABLE = """Full Name,E-Mail,Phone,Location,Country,Title,YOE,Tech Stack,email
ada byron,old@x.example,(415) 555-0142,"Paris, IDF, France",,Analyst,11,"Python, ReactJS,,Postgres",ADA@engine.example
Grace H.,bad-mail,12,,"US",Admiral,1_0,COBOL,grace@navy.example
"""


def pdf(lines):
    body = b"BT " + b" ".join(b"(%s) Tj T*" % x.encode().replace(b"(", rb"\(").replace(b")", rb"\)") for x in lines) + b" ET"
    return b"%PDF-1.4\n1 0 obj << /Length " + str(len(body)).encode() + b" >>\nstream\n" + body + b"\nendstream\nendobj\n%%EOF"


@pytest.fixture
def files(tmp_path):
    (tmp_path / "people.csv").write_text(TABLE)
    (tmp_path / "ada.pdf").write_bytes(pdf(RESUME.splitlines()))
    return [str(tmp_path / "people.csv"), str(tmp_path / "ada.pdf")]


CONFIG = {
    "fields": [
        {"path": "full_name", "type": "string", "required": True}, {"path": "mail", "from": "emails[0]", "type": "string"},
        {"path": "country", "from": "location.country"}, {"path": "skills", "from": "skills[].name", "type": "string[]"}, {"path": "phone", "from": "phones[0]", "normalize": "E164"},
    ],
    "include_provenance": False,
}


# -- sources -------------------------------------------------------------------


def test_kinds(spark):
    assert manifest.kind_of("a/B.CSV") == "csv" and manifest.kinds() == ["csv", "pdf"]
    for bad in ("x.txt", "x", "csv"):
        with pytest.raises(SourceError):
            manifest.kind_of(bad)
    with pytest.raises(KeyError):
        manifest.reader_of("docx")
    with pytest.raises(TypeError):
        manifest.register("docx", None)


def test_csv_rows(spark, files):
    rows = csv.read(spark, [(0, files[0])]).orderBy("seq").collect()
    ada, grace = rows
    assert ada.emails == ["ADA@engine.example"], "of two headers for one field the later counts"
    assert (ada.city, ada.region, ada.country, ada.years_experience) == ("Paris", "IDF", "France", 11.0)
    assert ada.skills == ["Python", "ReactJS", "Postgres"] and grace.years_experience == 10.0
    assert [p.field for p in ada.provenance] == ["full_name", "emails", "phones", "location.city", "location.region", "location.country", "headline", "years_experience", "skills"]
    assert {p.confidence for p in ada.provenance} == {0.84} and ada.source_file == "people.csv"


def test_csv_errors(spark, tmp_path):
    (tmp_path / "odd.csv").write_text("one,two\n1,2\n")
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "head.csv").write_text("name,email\n")
    with pytest.raises(MalformedCsv):
        csv.read(spark, [(0, str(tmp_path / "odd.csv"))])
    with pytest.raises(SourceError):
        csv.read(spark, [(0, str(tmp_path / "none.csv"))])
    assert csv.read(spark, [(0, str(tmp_path / "empty.csv"))]) is None
    assert read_sources(spark, [str(tmp_path / "empty.csv")]).count() == 0
    assert csv.read(spark, [(0, str(tmp_path / "head.csv"))]).count() == 0


def test_order_over_files(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"f {i}.csv").write_text("name\n" + "".join(f"n{i}-{k}\n" for k in range(20)))
    paths = [str(tmp_path / f"f {i}.csv") for i in (2, 0, 1)]
    got = [r.full_name for r in read_sources(spark, paths).orderBy("seq").collect()]
    assert got == [f"n{i}-{k}" for i in (2, 0, 1) for k in range(20)]


# -- extraction ----------------------------------------------------------------


def parsed(spark, text):
    return extract.parse_resumes(spark.createDataFrame([("r.pdf", 7, text)], "source_file string, seq long, text string"))


def test_resume(spark):
    r = parsed(spark, RESUME).first()
    assert r.full_name == "ADA BYRON" and r.emails == ["ada@engine.example"] and r.phones == ["+1 (415) 555-0142", "2015-2018"]
    assert (r.linkedin, r.portfolio, r.other_links) == ("https://linkedin.com/in/ada-byron", "https://ada.example/notes", [])
    assert (r.city, r.region, r.years_experience) == ("London", "UK", 12.0)
    assert r.skills == ["Python", "reactjs", "C Kubernetes", "Docker"]
    assert [tuple(e) for e in r.experience] == [
        ("Engine Works", "Lead Analyst", "Jan 2019", None, "kept from before Wrote the first notes Taught machines"),
        (None, "Programmer, Looms", "2015", "2018", "Cards"),
    ]
    assert [tuple(e) for e in r.education] == [("Home College", "B.Sc Mathematics", None, "2014"), (None, "Master of Numbers", None, "2016")]
    assert [p.field for p in r.provenance][-2:] == ["location.city", "location.region"] and r.provenance[1].method == "regex+phonenumbers"


def test_repeated_header_wins_and_blank_texts_give_nothing(spark):
    r = parsed(spark, "X\nSKILLS\nold thing\nSUMMARY\nhello\nSKILLS\nnew thing").first()
    assert r.skills == ["new thing"] and r.summary == "hello"
    assert parsed(spark, " \n\t").count() == 0 and parsed(spark, None).count() == 0
    r = parsed(spark, "EXPERIENCE\nSenior | Jan 2021 – Present").first()
    assert (r.experience[0].title, r.experience[0].company, r.experience[0].start) == ("Senior", "Jan 2021", None)


def test_long_resumes_are_read_once(spark):
    """The work grows with the lines, not with their square or cube."""
    job = "Dev | Acme {0} | Jan 2020 - Present\n- built {0}\nSide work {0} 2001 - 2002\n"
    text = "Ada Byron\n" + "x\n" * 3000 + "Work History:\n" + "".join(job.format(i) for i in range(1500)) + "= Education =\n" + "MIT, 2001\nB.Sc. Maths\n" * 500
    began = time.time()
    r = parsed(spark, text).first()
    assert time.time() - began < 20
    assert len(r.experience) == 3000 and tuple(r.experience[2]) == ("Acme 1", "Dev", "Jan 2020", None, "built 1")
    assert tuple(r.experience[2999]) == (None, "Side work 1499", "2001", "2002", None) and len(r.education) == 500


def test_header_lines(spark):
    heads = {"Skills": "skills", " ==Work History : ": "experience", "about me": "summary", "ABOUT:": "summary", "skills of all": None, "= =skills": None, "skills : :": None, "": None}
    rows = spark.createDataFrame([(h,) for h in heads] + [(None,)], "h string").select("h", extract.section_of(F.col("h")).alias("s"))
    assert {r.h: r.s for r in rows.collect()} == heads | {None: None}


# -- identity ------------------------------------------------------------------


def test_components_equal_union_find(spark):
    rng = random.Random(4)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i + 1000, i + 1001) for i in range(120)] + [(5, 5), (None, 3)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def records(spark, rows):
    return spark.createDataFrame([{**{k: None for k in PARSED}, "emails": [], "phones": [], "skills": [], "experience": [], "education": [], "other_links": [], "provenance": [], **r} for r in rows], ddl(PARSED))


def test_entities(spark):
    rows = [
        {"seq": 0, "full_name": "Ann", "emails": ["a@x"]}, {"seq": 1, "full_name": "Bob", "emails": ["A@x", "b@x"]}, {"seq": 2, "full_name": " ANN "},
        {"seq": 3, "full_name": " ", "emails": []}, {"seq": 4, "full_name": None, "emails": ["b@x"]}, {"seq": 5, "full_name": None},
    ]
    df = records(spark, rows)
    got = {r.seq: r.component for r in identity.entities(df).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 0, 5: 5}
    assert {r.seq: r.component for r in identity.entities(df, ("name",)).collect()} == {0: 0, 1: 1, 2: 0, 3: 3, 4: 4, 5: 5}


# -- merging -------------------------------------------------------------------


def test_priority_lists_and_gaps(spark):
    job = lambda c, t, s=None, e=None, x=None: (c, t, s, e, x)
    rows = [
        {"seq": 1, "source_type": "csv", "source_file": "a.csv", "full_name": "Low", "headline": "H", "emails": ["x@x", "Y@y"], "city": "",
         "experience": [job("Co", "Eng", None, "2020-01", "sum"), job(" CO ", "eng", "2019-01")], "skills": ["Python", "go"], "provenance": [("skills", "a.csv", "m", 0.84)]},
        {"seq": 2, "source_type": "pdf", "source_file": "b.pdf", "full_name": "High", "emails": ["y@Y"], "city": None,
         "experience": [job("co", "Eng", "2018-01")], "skills": ["python"], "provenance": [("skills", "b.pdf", "m", 0.92)]},
        {"seq": 3, "source_type": "csv", "source_file": "a.csv", "full_name": "Low 2", "city": "Rome", "skills": ["Rust"], "provenance": []},
    ]
    df = records(spark, rows).withColumn("component", F.lit(1))
    p = merge.resolve(df).first()
    assert (p.full_name, p.headline, p.location.city) == ("High", "H", ""), "an empty string is a value"
    assert p.emails == ["y@Y", "x@x"]
    assert [tuple(e) for e in p.experience] == [("co", "Eng", "2018-01", "2020-01", "sum")]
    assert [(s.name, s.confidence, s.sources) for s in p.skills] == [("go", 0.84, ["a.csv"]), ("Python", 0.93, ["b.pdf", "a.csv"]), ("Rust", 0.8, ["a.csv"])]
    assert [x.source for x in p.provenance] == ["b.pdf", "a.csv"]
    d = {r.field: r for r in merge.merge_decisions(merge.ordered(df)).collect()}
    assert (d["full_name"].winner_source, d["full_name"].loser_sources, d["full_name"].reason) == ("b.pdf", ["a.csv"], "priority: 100 > 80")
    assert d["headline"].reason == "single source"


def test_confidence(spark):
    marks = [("emails", "a", "m", 0.84), ("emails", "b", "m", 0.92), ("location.city", "a", "m", 0.5), ("location.region", "c", "m", 0.6)]
    df = spark.createDataFrame([(1, *m) for m in marks], "id int, field string, source string, method string, confidence double")
    got = {r.f: r.score for r in confidence.field_confidence(df.withColumn("f", confidence.top_field(F.col("field"))), ["id", "f"]).collect()}
    assert got == {"emails": 0.92 + 0.03, "location": 0.6 + 0.03}
    row = spark.range(1).select(confidence.weighted({"full_name": F.lit(0.9), "links": F.lit(None).cast("double"), "other": F.lit(0.5)}).alias("w"), confidence.weighted({"x": F.lit(0.0)}).alias("z")).first()
    assert abs(row.w - (0.9 * 3 + 0.5) / 4) < 1e-12 and row.z == 0.0


def test_end_to_end(spark, files, tmp_path):
    rows = transform(spark, files, projection.parse_config(CONFIG), ("email",)).collect()
    assert [(r.full_name, r.mail, r.country, r.phone) for r in rows] == [
        ("Ada Byron", "ada@engine.example", "FR", "+14155550142"), ("Grace H.", "grace@navy.example", "US", None),
    ]
    assert rows[0].skills == ["C Kubernetes", "Docker", "PostgreSQL", "Python", "React"] and 0 < rows[0].overall_confidence <= 1
    (tmp_path / "c.json").write_text(json.dumps(CONFIG))
    out = str(tmp_path / "out")
    assert cli.main(["--config", str(tmp_path / "c.json"), "--output", out]) == 1
    assert cli.main(["--csv", files[0], "--config", str(tmp_path / "none.json"), "--output", out]) == 2
    assert cli.main(["--csv", files[0], "--resume", files[1], "--config", str(tmp_path / "c.json"), "--output", out]) == 0
    assert sorted(json.loads(r.value)["full_name"] for r in spark.read.text(out).collect()) == ["Ada Byron", "Grace H."]
    again = profiles(normalize(read_sources(spark, files[::-1])), ("email",))
    ids = sorted(r.candidate_id for r in again.collect())
    assert ids == sorted(r.candidate_id for r in profiles(normalize(read_sources(spark, files)), ("email",)).collect())
    assert validate.without_provenance(again).count() == 0 and validate.confidence_violations(again, "overall_confidence").count() == 0


# -- projection and validation ---------------------------------------------------


@pytest.mark.parametrize(
    "data",
    [{}, {"fields": []}, {"fields": [{"path": "a"}, {"path": "a"}]}, {"fields": [{"path": "a b"}]}, {"fields": [{"path": "a", "from": "x[0].y"}]},
     {"fields": [{"path": "a", "from": "x[p]y"}]}, {"fields": [{"path": "a", "type": "text"}]}, {"fields": [{"path": "a", "normalize": "x"}]}, {"fields": [{"path": "a"}], "on_missing": "x"}],
)
def test_bad_configs(data):
    with pytest.raises(ConfigError):
        projection.parse_config(data)


def test_paths_and_policies(spark):
    df = spark.sql("select '' as e, array('a', '') as l, cast(array() as array<string>) as n, named_struct('x', 'v', 'y', cast(null as string)) as s, array(named_struct('k', 'p'), named_struct('k', cast(null as string))) as t")
    names = {"e": "e", "l0": "l[0]", "l1": "l[1]", "l9": "l[9]", "n": "n", "sx": "s.x", "k": "t[].k", "no": "what.ever"}
    fields = [{"path": p, "from": f} for p, f in names.items()]
    base = {"fields": fields, "include_confidence": False, "include_provenance": False}
    config = projection.parse_config(base)
    got = projection.project(df, config).first().asDict()
    assert got == {"e": None, "l0": "a", "l1": "", "l9": None, "n": None, "sx": "v", "k": ["p", None], "no": None}
    omit = projection.parse_config({**base, "on_missing": "omit", "fields": [{**f, "required": f["path"] == "e"} for f in fields]})
    shown = json.loads(projection.to_json(projection.project(df, omit), omit).first().json)
    assert shown == {"e": None, "l0": "a", "l1": "", "sx": "v", "k": ["p", None]}
    strict = projection.parse_config({**base, "strict_paths": True})
    with pytest.raises(ConfigError):
        projection.project(df, strict)
    error = projection.parse_config({**base, "on_missing": "error", "fields": [{"path": "e", "required": True}]})
    with pytest.raises(ProjectionError):
        projection.project(df, error)
    typed = projection.parse_config({**base, "fields": [{"path": "k", "from": "t[].k", "type": "string[]"}, {"path": "s", "type": "string"}, {"path": "e", "required": True}]})
    out = projection.project(df, typed)
    assert sorted(r.violation for r in validate.violations(out, typed).collect()) == ["e: required", "k: null element", "s: not string"]
    with pytest.raises(ValidationError):
        validate.validate(out, typed)


def test_rules_of_rows_without_confidence(spark):
    """A config asks for confidence unless it says no; rows that were not projected may have none."""
    rows = spark.sql("select * from values (1, 'a', array('x')), (2, null, array('x', null)), (3, null, null) as t(id, name, marks)")
    config = projection.parse_config({"fields": [{"path": "name", "required": True}, {"path": "id", "type": "string"}, {"path": "marks", "type": "string[]"}]})
    broken = lambda df: sorted((r.id, r.violation) for r in validate.violations(df, config).collect())
    plain = [(1, "id: not string"), (2, "id: not string"), (2, "marks: null element"), (2, "name: required"), (3, "id: not string"), (3, "name: required")]
    assert broken(rows) == plain
    with pytest.raises(ValidationError, match=r"id: not string \(3 rows\); marks: null element \(1 rows\); name: required \(2 rows\)"):
        validate.validate(rows, config)
    scored = rows.withColumn("overall_confidence", F.when(F.col("id") < 3, F.col("id") * 0.9))
    assert broken(scored) == sorted([*plain, (2, "overall_confidence: not between 0 and 1")])


def test_audit(spark):
    df = spark.createDataFrame([("b", "Ab", 0.95), ("A", None, 0.8), ("c", "x", 0.1)], "field string, source string, c double")
    assert [r.field for r in audit.sort(audit.search(df, "AB", ["field", "source"]), "field").collect()] == ["b"]
    assert [r.field for r in audit.sort(df, "field").collect()] == ["A", "b", "c"]
    assert [r.t for r in df.select(audit.tier(F.col("c")).alias("t")).collect()] == ["high", "medium", "low"]
    logs = spark.createDataFrame([("INFO", "s1", "hello"), ("WARN", "s2", "Hello")], "level string, stage string, message string")
    assert audit.log_filter(logs, "WARN", "hell").count() == 1 and audit.log_filter(logs, None, "S1").count() == 1 and audit.log_filter(logs).count() == 2


def random_records(spark, seed, n=150):
    rng = random.Random(seed)
    pick = lambda *v: rng.choice(v)
    mark = lambda: (pick("emails", "links.github", "skills", "full_name"), pick("a.csv", "b.pdf"), pick("m", "regex"), pick(0.5, 0.8, 0.84))
    rows = []
    for i in range(n):
        job = lambda: (pick("Acme", "acme ", "", None), pick("Dev", "dev", None), pick("2020-01", "", None), pick("2021-01", None), pick("x", "", None))
        school = lambda: (pick("MIT", "mit", ""), pick("BSc", None), pick("CS", None), pick("2010", "", None))
        rows.append((
            pick("csv", "pdf", "other"), pick("a.csv", "b.pdf", "c.csv"), i, pick("Ann", "ANN", None, ""), [pick("a@x", "A@x", "b@x") for _ in range(rng.randrange(3))],
            pick(None, ["+1", "+2"], []), pick("X", "", None), pick("Y", None), pick("US", None), pick("l", None), pick("g", None), pick(None, "p"),
            pick([], ["http://z", "HTTP://z"], None), pick("h", None), pick("c", None), pick(1.5, 0.0, None), [pick("Go", "go", "GO", "rust") for _ in range(rng.randrange(4))],
            [job() for _ in range(rng.randrange(3))], [school() for _ in range(rng.randrange(3))], None, pick([mark() for _ in range(rng.randrange(4))], None), rng.randrange(20),
        ))
    rows.append((None, "d.csv", n, *[None] * 18, 99))
    return spark.createDataFrame(rows, ddl(PARSED) + ", component long")


def test_cells_give_what_the_rules_give_one_by_one(spark):
    from kinfold.operators import merge

    records = random_records(spark, 11).repartition(3)
    rows = merge.ordered(records)
    got = {r.component: r for r in merge.resolve(records, scores=tuple(confidence.active())).collect()}
    assert set(got) == {r.component for r in records.select("component").distinct().collect()} and 99 in got
    for r in merge.merge_scalars(rows).collect():
        p = got[r.component]
        assert (p.full_name, p.headline, p.years_experience) == (r.full_name, r.headline, r.years_experience)
        assert tuple(p.location) == (r.city, r.region, r.country) and tuple(p.links)[:3] == (r.linkedin, r.github, r.portfolio)
    one = {
        "emails": merge.merge_lists(rows, ("emails",)), "phones": merge.merge_lists(rows, ("phones",)), "skills": merge.merge_skills(rows),
        "experience": merge.merge_entries(rows, "experience", *merge.ENTRIES["experience"]), "education": merge.merge_entries(rows, "education", *merge.ENTRIES["education"]),
        "provenance": merge.provenance_table(rows).groupBy("component").agg(merge.gathered(F.struct("ord", "pos"), F.struct("field", "source", "method", "confidence")).alias("provenance")),
    }
    for name, rows_of in one.items():
        want = {r.component: r[name] for r in rows_of.collect()}
        assert {c: p[name] for c, p in got.items() if p[name]} == {c: v for c, v in want.items() if v}, name
    for r in confidence.score_columns(merge.provenance_table(rows)).collect():
        for name in confidence.active():
            a, b = got[r.component][f"_score_{name}"], r[f"_score_{name}"]
            assert a == b or abs(a - b) < 1e-12, (name, a, b)


@pytest.mark.parametrize("few", [5, 60, 400])
@pytest.mark.parametrize("provenance", [True, False])
def test_arrays_give_what_cells_give(spark, monkeypatch, few, provenance):
    """All entities as arrays, some, or nearly none."""
    from kinfold.operators import scratch

    monkeypatch.setattr(merge, "FEW", few)
    records = random_records(spark, 12, 400).withColumn("component", F.when(F.col("seq") % 3 == 0, F.col("component")).otherwise(F.col("seq") % 50)).repartition(3)
    records = records.withColumn("skills", F.when(F.col("seq") % 29 == 0, F.array(F.lit("go"), F.lit(None).cast("string"))).otherwise(F.col("skills")))
    records = scratch.settle(records.withColumn("source_file", F.when(F.col("seq") % 31 != 0, F.col("source_file"))), "random")
    scores = tuple(confidence.active())
    got, want = merge.merged(records, provenance=provenance, scores=scores), merge.resolve(records, provenance=provenance, scores=scores)
    assert got.columns == want.columns and [t for _, t in got.dtypes] == [t for _, t in want.dtypes]
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) and want.count() == 50


def test_small_entities_are_shuffled_once(spark, tmp_path):
    random_records(spark, 2).filter("component < 20").write.parquet(str(tmp_path / "records"))
    out = merge.merged(spark.read.parquet(str(tmp_path / "records")), scores=tuple(confidence.active()))
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange ") == 1 and plan.count("FileScan") == 1 and "Join" not in plan


def test_merge_scans_once_and_shuffles_three_times(spark, tmp_path):
    from kinfold.operators import merge

    random_records(spark, 2).write.parquet(str(tmp_path / "records"))
    out = merge.resolve(spark.read.parquet(str(tmp_path / "records")), scores=tuple(confidence.active()))
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange ") <= 3 and plan.count("FileScan") == 1 and "Join" not in plan


def test_export_checks_in_the_pass_that_writes(spark, files, tmp_path):
    from kinfold.plans.pipeline import export

    fields = [{"path": "candidate_id", "required": True}, {"path": "full_name"}]
    good = projection.parse_config({"fields": fields, "include_provenance": False})
    export(spark, files, good, str(tmp_path / "out"))
    export(spark, files, good, str(tmp_path / "array"), array=True)
    lines = [json.loads(x) for p in sorted((tmp_path / "out").glob("part-*")) for x in p.read_text().splitlines()]
    array = json.loads("".join(p.read_text() for p in sorted((tmp_path / "array").glob("part-*"))))
    assert sorted(map(str, lines)) == sorted(map(str, array)) and len(lines) == 2
    for policy, error in (("error", ProjectionError), ("null", ValidationError)):
        bad = projection.parse_config({"fields": [*fields, {"path": "job", "from": "links.portfolio", "required": True}], "on_missing": policy, "include_provenance": False})
        for array in (False, True):
            with pytest.raises(error, match="job.*[12]"):
                export(spark, files, bad, str(tmp_path / "bad"), array)
            assert not (tmp_path / "bad").exists(), "no output of a run that fails"


# -- streaming -----------------------------------------------------------------


def test_stream_merges_over_batches(spark, files, tmp_path):
    source, store = tmp_path / "in", tmp_path / "store"
    seen = []
    for i, path in enumerate(files):
        read_sources(spark, [path]).withColumn("seq", F.col("seq") + (i << 50)).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(ddl(PARSED)).parquet(str(source))
        query = merge_stream(stream, str(store), str(tmp_path / "cp"), lambda p, n, old: seen.append((n, p.count(), old.count())))
        query.processAllAvailable()
        query.stop()
    assert seen == [(0, 2, 0), (1, 1, 1)], "the second batch touches one entity only"


def test_batches_end_where_one_merge_does(spark, tmp_path):
    """Entities that later records bridge, records without keys, and a batch that runs again."""
    from kinfold.streaming.incremental import Store, merge_batch

    def batch(rows):
        made = [(i, "csv", "a.csv", n, e, [], []) for i, n, e in rows]
        df = spark.createDataFrame(made, "seq long, source_type string, source_file string, full_name string, emails array<string>, phones array<string>, skills array<string>")
        return df.select(*[F.col(c).cast(t).alias(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in PARSED.items()])

    parts = [
        [(1, "Ann", ["a@x.org"]), (2, "Bob", ["b@x.org"]), (3, None, [])], [(4, "Cid", ["a@x.org", "c@x.org"]), (5, "Dan", [])],
        [(6, "Eve", ["c@x.org", "b@x.org"])], [(7, "dan ", [])],
    ]
    store, state = Store(str(tmp_path / "s")), {}
    for n, rows in enumerate(parts):
        for _ in range(2):
            changed, replaced = merge_batch(batch(rows), n, store)
            gone = {r.component for r in replaced.collect()}
            fresh = {r.component: r.candidate_id for r in changed.collect()}
        state = {c: i for c, i in state.items() if c not in gone} | fresh
    whole = profiles(normalize(batch([r for rows in parts for r in rows]))).collect()
    assert state == {r.component: r.candidate_id for r in whole} and len(state) == 3


def test_windowed_stream(spark, small, tmp_path):
    whole = spark.read.parquet(f"{small}/events.parquet")
    whole.repartition(2).write.parquet(str(tmp_path / "e"))
    stream = windowed_counts(spark.readStream.schema(whole.schema).parquet(str(tmp_path / "e")))
    query = stream.writeStream.outputMode("complete").format("memory").queryName("counts").start()
    query.processAllAvailable()
    query.stop()
    key = lambda rows: sorted((str(r.start), r.event_type, r.n) for r in rows)
    assert key(spark.table("counts").collect()) == key(windowed_counts(whole).collect())


def test_run_log(spark, files):
    from kinfold.plans.metrics import RunLog

    log = RunLog()
    rows = log.watch(read_sources(spark, files), "parse", named=F.count("full_name"))
    rows = log.watch(rows.filter("full_name is null"), "unnamed")
    rows.collect()
    got = {r.stage: (r.level, r.message) for r in log.table(spark).collect()}
    assert got == {"parse": ("INFO", "rows=3, named=3"), "unnamed": ("WARN", "rows=0")}
    assert audit.log_filter(log.table(spark), "WARN").count() == 1


def test_scratch_tables_are_cleared(spark):
    import os

    from kinfold.operators import scratch

    df = scratch.settle(spark.range(3), "three")
    path = df.inputFiles()[0].removeprefix("file://")
    assert df.count() == 3 and os.path.exists(path)
    scratch.clear(spark)
    assert not os.path.exists(path)


def test_confidence_without_gathered_provenance(spark, files):
    rows = normalize(read_sources(spark, files))
    whole, bare = profiles(rows), profiles(rows, provenance=False)
    assert "provenance" in whole.columns and "provenance" not in bare.columns
    got = {r.candidate_id: r.overall_confidence for r in bare.collect()}
    for r in whole.collect():
        top = {}
        for m in r.provenance:
            top.setdefault(m.field.split(".")[0], []).append((m.source, m.confidence))
        has = r.asDict(recursive=True) | {"location": any(r.location), "links": r.links.linkedin or r.links.github or r.links.portfolio}
        total = weight = 0.0
        for n in confidence.active():
            if n in top and has[n] not in (None, "", [], False):
                w = K.FIELD_WEIGHTS.get(n, K.DEFAULT_WEIGHT)
                score = min(max(c for _, c in top[n]) + K.CORROBORATION * (len({s for s, _ in top[n]}) - 1), 1.0)
                total, weight = total + w * score, weight + w
        assert r.overall_confidence == got[r.candidate_id] and abs(r.overall_confidence - total / weight) < 1e-4
    asks = lambda **d: projection.asks_provenance(projection.parse_config({"fields": [{"path": "a", "from": d.pop("source", "full_name")}], **d}))
    assert asks() and not asks(include_provenance=False) and asks(include_provenance=False, source="provenance")


def test_entity_profiles_merge_on_names(spark, tmp_path):
    spark.createDataFrame([(10, "Grace Hopper", "BUILDING"), (21, "Alan Kay", "BUILDING")], "c_custkey long, c_name string, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    texts = ["Ada Byron\n\nSkills\nPython", "Ada Byron\n\nSkills\nDocker", "grace hopper\n\nSkills\nDocker"]
    spark.createDataFrame([(i, "web", t) for i, t in enumerate(texts)], "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.entity_profiles(spark, str(tmp_path)).collect()
    assert sorted(r.full_name.lower() for r in rows) == ["ada byron", "alan kay", "grace hopper"]
