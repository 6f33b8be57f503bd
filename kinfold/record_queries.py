"""Whole records through the library's own stages, on texts, files and rows that
Spark makes of the driver's tables, with their SQL.

A customer is written as a resume, as a line of a CSV file or as both, so that
every rule of extraction, normalisation and merging has a result that SQL can
state.  All queries work on their tables whole.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.functions import contact
from kinfold.operators import audit, confidence, extract, identity, merge, projection, validate
from kinfold.operators.scratch import made, scratch_dir, settle
from kinfold.operators.prefix import ordered_totals
from kinfold.operators.spread import spread
from kinfold.plans.metrics import RunLog
from kinfold.plans.pipeline import json_array, normalize, profiles, read_folder
from kinfold.queries import QUERIES, SQL, query, table  # noqa: F401  the two are what the entry module reads
from kinfold.sources import csv as csv_source
from kinfold.sources import resume

FIRST = ("Ada", "Bo", "Cy", "Di")
LAST = ("Lovelace", "Smith-Jones", "O'Neil")
_NAME = "['Ada', 'Bo', 'Cy', 'Di'][(c_custkey % 4 + 1)::INTEGER] || ' ' || ['Lovelace', 'Smith-Jones', 'O''Neil'][(c_custkey % 3 + 1)::INTEGER]"
_LINKEDIN = "CASE WHEN c_custkey % 3 = 0 THEN 'https://www.linkedin.com/in/p-' || c_custkey END"
_GITHUB = "CASE WHEN c_custkey % 3 = 1 THEN 'github.com/p_' || c_custkey END"
_PORTFOLIO = "CASE WHEN c_custkey % 3 = 2 THEN 'https://site.org/' || c_custkey END"
_LINE = "lpad((c_custkey % 10000)::VARCHAR, 4, '0')"


def _pick(names: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), (F.col("c_custkey") % len(names) + 1).cast("int"))


def _resumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_file, seq, text): customers as resumes with all sections."""
    k = F.col("c_custkey")
    s = k.cast("string")
    name = F.concat(_pick(FIRST), F.lit(" "), _pick(LAST))
    link = F.when(k % 3 == 0, F.concat(F.lit("https://www.linkedin.com/in/p-"), s)).when(
        k % 3 == 1, F.concat(F.lit("github.com/p_"), s)
    ).otherwise(F.concat(F.lit("see https://site.org/"), s, F.lit(" and https://other.org/x")))
    lines = [
        F.concat(F.lit("  "), name), F.concat(F.lit("Springfield, IL 62701 | p"), s, F.lit("@x.org | "), F.format_string("(415) 555-%04d", k % 10000)), link,
        F.lit("Skills"), F.lit("Cobol, Ada"), F.lit("Profile:"), F.concat(F.lit("Engineer with "), (k % 30).cast("string"), F.lit("+ years of experience")),
        F.lit("= Work History ="), F.lit("- before any entry"), F.lit("Developer | Acme | Jan 2020 - Present"), F.lit("• built a"), F.lit("an ignored line"),
        F.lit("Analyst – Initech 03/2015 - 06/2018"), F.lit("- c"), F.lit("- d 2001 - 2002"), F.lit(""),
        F.lit("EDUCATION"), F.lit("B.Sc. Physics, 2014"), F.lit("MIT"), F.lit("PhD Logic"), F.lit("ETH Zurich, 2018"), F.lit("Master of Arts 1999 |"),
        F.lit("Skills"), F.lit("Python, js | C, Spark;  R"), F.lit("react.js · Go lang"),
    ]
    return spread(table(spark, sf_dir, "customer")).select(F.lit("cv.pdf").alias("source_file"), k.alias("seq"), F.array_join(F.array(*lines), "\n").alias("text"))


def _joined(entries: Column, *names: str) -> Column:
    part = lambda e: F.concat_ws(":", *[F.coalesce(e[n], F.lit("-")) for n in names])
    return F.array_join(F.transform(entries, part), "|")


_JOBS = "'Developer:Acme:Jan 2020:-:before any entry built a|Analyst:Initech:03/2015:06/2018:c|- d:-:2001:2002:-'"
_DEGREES = "'B.Sc. Physics:MIT:2014|PhD Logic:ETH Zurich:2018|Master of Arts:-:1999'"


@query(f"""
SELECT c_custkey AS seq, {_NAME} AS full_name, 'Springfield' AS city, 'IL' AS region, 'p' || c_custkey || '@x.org' AS emails,
       {_LINKEDIN} AS linkedin, {_GITHUB} AS github, {_PORTFOLIO} AS portfolio, CASE WHEN c_custkey % 3 = 2 THEN 'https://other.org/x' ELSE '' END AS other_links,
       'Engineer with ' || c_custkey % 30 || '+ years of experience' AS summary, (c_custkey % 30)::DOUBLE AS years,
       'Python|js|Spark|R react.js|Go lang' AS skills, {_JOBS} AS jobs, {_DEGREES} AS degrees,
       'emails:0.874|phones:0.874|links.' || CASE c_custkey % 3 WHEN 0 THEN 'linkedin' WHEN 1 THEN 'github' ELSE 'portfolio' END || ':0.874|full_name:0.828|skills:0.828|experience:0.828|education:0.828|summary:0.828|years_experience:0.874|location.city:0.874|location.region:0.874' AS marks
FROM customer
""")
def resume_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every field of a resume, its history and its marks in order."""
    marks = F.transform("provenance", lambda p: F.concat_ws(":", p["field"], F.round(p["confidence"], 3).cast("string")))
    return extract.parse_resumes(_resumes(spark, sf_dir)).select(
        "seq", "full_name", "city", "region", F.array_join("emails", ",").alias("emails"), "linkedin", "github", "portfolio",
        F.array_join("other_links", ",").alias("other_links"), "summary", F.col("years_experience").alias("years"), F.array_join("skills", "|").alias("skills"),
        _joined(F.col("experience"), "title", "company", "start", "end", "summary").alias("jobs"),
        _joined(F.col("education"), "degree", "institution", "end_year").alias("degrees"), F.array_join(marks, "|").alias("marks"),
    )


@query(f"""
SELECT c_custkey AS seq, '+1415555' || {_LINE} AS phone, 'Python|JavaScript|Spark|R react.js|Go lang' AS skills,
       '2020-01:-|2015-03:2018-06|2001-01:2002-01' AS spans, 'IL' AS region, {_NAME} AS full_name FROM customer
""")
def resume_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names, phones, skills, regions and the dates of histories after normalising."""
    rows = normalize(extract.parse_resumes(_resumes(spark, sf_dir)))
    return rows.select(
        "seq", F.array_join("phones", ",").alias("phone"), F.array_join("skills", "|").alias("skills"),
        _joined(F.col("experience"), "start", "end").alias("spans"), "region", "full_name",
    )


def _pdf(text: Column) -> Column:
    """A small PDF file that shows a text line by line."""
    shown = F.array_join(F.transform(F.split(text, "\n"), lambda x: F.concat(F.lit("("), x, F.lit(") Tj T*\n"))), "")
    body = F.concat(F.lit("BT\n"), shown, F.lit("ET"))
    return F.concat(F.lit("%PDF-1.4\n1 0 obj << /Length "), F.length(body).cast("string"), F.lit(" >> stream\n"), body, F.lit("\nendstream endobj\n%%EOF")).cast("binary")


@query("""
SELECT s_suppkey AS seq, 'Name ' || s_suppkey || chr(10) || s_name || chr(10) || 'Springfield, IL' AS text FROM supplier WHERE s_suppkey % 4 <> 3
""")
def pdf_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as PDF files; those that are no PDF give no row."""
    text = F.concat(F.lit("Name "), F.col("s_suppkey").cast("string"), F.lit("\n"), "s_name", F.lit("\nSpringfield, IL"))
    content = F.when(F.col("s_suppkey") % 4 == 3, F.encode(text, "UTF-8")).otherwise(_pdf(text))
    files = table(spark, sf_dir, "supplier").select(F.lit("a.pdf").alias("source_file"), F.col("s_suppkey").alias("seq"), content.alias("content"))
    return resume.texts(files).select("seq", "text")


# -- files -------------------------------------------------------------------------


@query("""
SELECT c_custkey AS key, 'part-' || c_custkey % 3 AS kind, CASE c_custkey % 3 WHEN 1 THEN NULL ELSE c_name END AS full_name,
       'C' || c_custkey || '@x.org' AS email, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment || ',' || chr(10) || '"' || c_name END AS headline,
       CASE WHEN c_custkey % 3 = 2 AND c_custkey % 2 = 0 THEN 'b' || c_custkey END AS city, CASE WHEN c_custkey % 3 = 2 THEN 'x,"y' END AS company
FROM customer
""")
def csv_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers written as CSV files under three headers, a header in each file,
    and read again: aliases of columns, unknown columns, quotes, line breaks in
    cells, and two headers of one field, of which the later counts even where it
    is blank."""
    k = F.col("c_custkey")
    mail = F.concat(F.lit("C"), k.cast("string"), F.lit("@x.org"))
    rows = spread(table(spark, sf_dir, "customer"))
    where = f"{scratch_dir(spark)}/kinfold/csv-{uuid.uuid4().hex}"
    shapes = [
        {" Full Name": F.col("c_name"), "E-Mail": mail, "Position": F.concat("c_mktsegment", F.lit(',\n"'), "c_name"), "Shoe size": F.lit("z")},
        {"email address": mail, "balance": F.col("c_acctbal").cast("string")},
        {
            "candidate_name": F.col("c_name"), "city": F.lit("a"), "email": mail, "Employer": F.lit('x,"y'),
            "CITY ": F.when(k % 2 == 0, F.concat(F.lit("b"), k.cast("string"))).otherwise(""),
        },
    ]
    files: list[tuple[int, str]] = []
    for i, shape in enumerate(shapes):
        cells = rows.filter(k % 3 == i).select(*[c.alias(name) for name, c in shape.items()])
        cells.write.options(header=True, quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, emptyValue="").csv(f"{where}/{i}")
        made(spark, f"{where}/{i}")
        files += [(1000 * i + j, f) for j, f in enumerate(spark.read.text(f"{where}/{i}").inputFiles())]
    found = csv_source.read(spark, files)
    mail = F.get("emails", F.lit(0))
    key = F.regexp_extract(mail, "([0-9]+)@", 1).cast("long")
    return found.select(
        key.alias("key"), F.concat(F.lit("part-"), F.floor(F.shiftright("seq", csv_source.ROWS) / 1000).cast("string")).alias("kind"), "full_name", mail.alias("email"),
        "headline", "city", F.col("current_company").alias("company"),
    )


@query("""
SELECT c_custkey AS key, c_name || chr(10) || 'of ' || c_mktsegment AS name, NULL AS reason FROM customer WHERE c_custkey % 2 = 0
UNION ALL SELECT -1, NULL, unnest(['unknown kind of source', 'no recognizable columns'])
""")
def folder_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second customer as CSV files in a folder that also holds files of an
    unknown kind and files without known columns: records, and why files gave none."""
    k = F.col("c_custkey")
    rows, where = spread(table(spark, sf_dir, "customer")), f"{scratch_dir(spark)}/kinfold/folder-{uuid.uuid4().hex}"
    cells = rows.filter(k % 2 == 0).select(F.concat("c_name", F.lit("\nof "), "c_mktsegment").alias("Name"), F.concat(k.cast("string"), F.lit("@x.org")).alias("email"))
    cells.write.options(header=True, quoteAll=True, escape='"').csv(f"{where}/good")
    rows.select(k.alias("shoe"), F.col("c_acctbal").alias("size")).write.options(header=True).csv(f"{where}/odd")
    rows.select("c_name").write.text(f"{where}/text")
    made(spark, where)
    records, odd = read_folder(spark, where)
    key = F.regexp_extract(F.get("emails", F.lit(0)), "^([0-9]+)@", 1).cast("long")
    found = records.select(key.alias("key"), F.col("full_name").alias("name"), F.lit(None).cast("string").alias("reason"))
    return found.unionByName(odd.select(F.lit(-1).cast("long").alias("key"), F.lit(None).cast("string").alias("name"), "reason").distinct())


# -- checks while writing --------------------------------------------------------------


@query("""
SELECT unnest(['name: required', 'tags: null element', 'size: not string', 'overall_confidence: not between 0 and 1']) AS rule,
       unnest([count(*) FILTER (c_custkey % 7 = 0), count(*) FILTER (c_custkey % 5 = 0), count(c_acctbal), count(*) FILTER (c_acctbal / 9000 NOT BETWEEN 0 AND 1)]) AS n
FROM customer
""")
def observed_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that break each rule of a config, counted while the rows are written:
    required fields, types, null elements and confidence between 0 and 1."""
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(
        F.when(k % 7 != 0, F.col("c_name")).alias("name"), F.array(F.lit("a"), F.when(k % 5 != 0, F.col("c_mktsegment"))).alias("tags"),
        F.col("c_acctbal").alias("size"), (F.col("c_acctbal") / 9000).alias("overall_confidence"),
    )
    fields = [{"path": "name", "required": True}, {"path": "tags", "type": "string[]"}, {"path": "size", "type": "string"}]
    config = projection.parse_config({"fields": fields, "include_confidence": True, "include_provenance": False})
    seen, watch = validate.watched(projection.project(rows, config, check=False), config)
    settle(seen, "checked")
    return spark.createDataFrame(list(watch.counts().items()), "rule string, n long")


# -- profiles ----------------------------------------------------------------------


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as list rows and as resumes, normalised: one e-mail for both."""
    k = F.col("c_custkey")
    s = k.cast("string")
    cells = spread(table(spark, sf_dir, "customer")).select(
        F.lit("list.csv").alias("source_file"), k.alias("seq"), F.concat(F.upper(_pick(FIRST)), F.lit(" LISTED")).alias("full_name"),
        F.concat(F.lit("P"), s, F.lit("@X.org")).alias("email"), F.format_string("+44 20 7946 %04d", k % 10000).alias("phone"),
        F.when(k % 2 == 0, "Boston, MA, usa").alias("location"), F.when(k % 4 == 1, "Engineer").alias("headline"), F.lit("40").alias("years_experience"),
        F.lit("python, docker").alias("skills"), F.concat(F.lit("https://site.org/own"), s).alias("portfolio"),
    )
    cv = _resumes(spark, sf_dir).withColumn("seq", F.col("seq") + (1 << 40))
    return normalize(csv_source.records(cells).unionByName(extract.parse_resumes(cv)))


_PROFILE = f"""
WITH c AS (
  SELECT c_custkey, {_NAME} AS name, 'p' || c_custkey || '@x.org' AS email, '+1415555' || {_LINE} AS home, '+44207946' || {_LINE} AS abroad FROM customer)
"""


@query(f"""
{_PROFILE}
SELECT c_custkey AS seq, sha256(lower(name) || '||' || email || '||' || home || '|' || abroad) AS candidate_id, name AS full_name, email AS emails,
       home || ',' || abroad AS phones, 'Springfield' AS city, 'IL' AS region, CASE WHEN c_custkey % 2 = 0 THEN 'US' END AS country,
       CASE WHEN c_custkey % 3 = 2 THEN 'https://site.org/' || c_custkey ELSE 'https://site.org/own' || c_custkey END AS portfolio,
       CASE WHEN c_custkey % 4 = 1 THEN 'Engineer' END AS headline, (c_custkey % 30)::DOUBLE AS years,
       'Docker:0.84:list.csv|Go lang:0.828:cv.pdf|JavaScript:0.828:cv.pdf|Python:0.884:cv.pdf,list.csv|R react.js:0.828:cv.pdf|Spark:0.828:cv.pdf' AS skills,
       'Developer:2020-01|Analyst:2015-03|- d:2001-01' AS jobs, 'MIT|ETH Zurich|-' AS degrees,
       (11 + 6 + 3 * (c_custkey % 2 = 0)::INTEGER + (c_custkey % 4 = 1)::INTEGER)::INTEGER AS n_marks,
       round((3 * 0.87 + 2 * 0.904 + 2 * 0.904 + 2 * 0.87 + 2 * 0.828 + 0.828 + 0.904 + CASE WHEN c_custkey % 3 = 2 THEN 0.904 ELSE 0.904 END * 0.5
         + CASE WHEN c_custkey % 2 = 0 THEN 0.904 ELSE 0.874 END + CASE WHEN c_custkey % 4 = 1 THEN 0.84 ELSE 0 END)::DOUBLE
         / (14.5 + (c_custkey % 4 = 1)::INTEGER), 4) AS overall
FROM c
""")
def merged_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """List row and resume of each customer as one profile: the resume's values
    count first, lists are united, skills and fields gain from both sources."""
    out = profiles(_records(spark, sf_dir), (identity.EMAIL,))
    skill = F.transform("skills", lambda s: F.concat_ws(":", s["name"], s["confidence"].cast("string"), F.array_join(s["sources"], ",")))
    return out.select(
        F.col("component").alias("seq"), "candidate_id", "full_name", F.array_join("emails", ",").alias("emails"), F.array_join("phones", ",").alias("phones"),
        "location.city", "location.region", "location.country", "links.portfolio", "headline", F.col("years_experience").alias("years"),
        F.array_join(skill, "|").alias("skills"), _joined(F.col("experience"), "title", "start").alias("jobs"),
        _joined(F.col("education"), "institution").alias("degrees"), F.size("provenance").alias("n_marks"), F.col("overall_confidence").alias("overall"),
    )


@query("""
SELECT c_custkey AS seq, field, score FROM (
  SELECT c_custkey, unnest(['full_name', 'emails', 'phones', 'location', 'links', 'headline', 'years_experience', 'skills', 'experience', 'education']) AS field,
         unnest([0.87, 0.904, 0.904, CASE WHEN c_custkey % 2 = 0 THEN 0.904 ELSE 0.874 END, 0.904, CASE WHEN c_custkey % 4 = 1 THEN 0.84 END, 0.904, 0.87, 0.828, 0.828]::DOUBLE[]) AS score FROM customer)
WHERE score IS NOT NULL
""")
def profile_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The confidence of each field that a profile has, from its marks as rows."""
    found = settle(identity.entities(settle(_records(spark, sf_dir), "records"), (identity.EMAIL,)), "entities")
    profile = merge.merged(found, provenance=False, scores=tuple(confidence.active()))
    one = [F.struct(F.lit(n).alias("field"), F.round(F.when(on, F.col(f"_score_{n}")), 4).alias("score")) for n, on in confidence.active().items()]
    rows = profile.select(F.col("component").alias("seq"), F.explode(F.array(*one)).alias("x")).select("seq", "x.*")
    return rows.filter("score is not null")


@query("""
SELECT c_custkey AS seq, unnest(CASE WHEN c_custkey % 5 = 0 THEN ['experience', 'headline'] ELSE ['headline'] END) AS field FROM customer WHERE c_custkey % 4 = 1
UNION ALL SELECT c_custkey, 'experience' FROM customer WHERE c_custkey % 5 = 0 AND c_custkey % 4 <> 1
""")
def unmarked_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields that have a value, but whose marks have been taken away."""
    out = profiles(_records(spark, sf_dir), (identity.EMAIL,))
    cut = F.when(F.col("component") % 5 == 0, F.filter("provenance", lambda p: p["field"] != "experience")).otherwise(F.col("provenance"))
    out = out.withColumn("provenance", F.filter(cut, lambda p: p["field"] != "headline")).withColumn("candidate_id", F.col("component"))
    return validate.without_provenance(out).select(F.col("candidate_id").alias("seq"), "field")


@query("""
WITH c AS (SELECT *, bool_or(c_custkey % 3 = 1) OVER (PARTITION BY c_nationkey, c_custkey % 2) AS bridged FROM customer)
SELECT min(c_custkey) AS component, count(*)::BIGINT AS records FROM c GROUP BY c_nationkey, c_custkey % 2, CASE WHEN bridged THEN 0 ELSE c_custkey % 3 END
""")
def name_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities by e-mail or name, as by default: of each nation's customers some
    have an address only, some a name only, and some both, which bridge them."""
    k, n = F.col("c_custkey"), F.concat_ws("-", F.col("c_nationkey").cast("string"), (F.col("c_custkey") % 2).cast("string"))
    mail = F.when(k % 3 == 0, F.concat(F.lit(" M"), n, F.lit("@x.org"))).when(k % 3 == 1, F.concat(F.lit("m"), n, F.lit("@X.org ")))
    name = F.when(k % 3 == 1, F.concat(F.lit("Name "), n)).when(k % 3 == 2, F.concat(F.lit("  NAME "), n, F.lit(" ")))
    rows = table(spark, sf_dir, "customer").select(k.alias("seq"), F.array_compact(F.array(mail)).alias("emails"), name.alias("full_name"))
    return identity.entities(settle(rows, "named")).groupBy("component").agg(F.count("*").alias("records"))


# -- phones abroad -------------------------------------------------------------------


@query("""
SELECT s_suppkey, CASE s_suppkey % 6 WHEN 0 THEN '+44207946' || d WHEN 1 THEN '+4930' || d || '5' WHEN 2 THEN '+81312' || d || '67' WHEN 5 THEN '+1415555' || d END AS phone
FROM (SELECT s_suppkey, lpad((s_suppkey % 10000)::VARCHAR, 4, '0') AS d FROM supplier)
""")
def phones_abroad(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers with calling codes, of which one is not in use and one too short."""
    d = F.format_string("%04d", F.col("s_suppkey") % 10000)
    shapes = [
        F.concat(F.lit(" +44 20 7946 "), d), F.concat(F.lit("+49-30-"), d, F.lit("5")), F.concat(F.lit("+81 (3) 12"), d, F.lit("67")),
        F.concat(F.lit("+83 1234 "), d), F.concat(F.lit("+44 "), F.substring(d, 1, 3)), F.concat(F.lit("415.555."), d, F.lit(" ext. 12")),
    ]
    raw = F.element_at(F.array(*shapes), (F.col("s_suppkey") % len(shapes) + 1).cast("int"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", contact.normalize_phone(raw).alias("phone"))


# -- configs -------------------------------------------------------------------------

_CONFIGS = [
    ('{"fields": [{"path": "a", "type": "string"}]}', None),
    ('{"fields": []}', "a config needs a list of at least one field"),
    ('{"fields": [{"path": "a"}, {"path": "a", "from": "b"}]}', "output path 'a' is given twice"),
    ('{"fields": [{"path": "a-b", "from": "a"}]}', "output path 'a-b' must be letters, digits and underscores"),
    ('{"fields": [{"path": "a", "type": "text"}]}', "unknown type 'text' of 'a'"),
    ('{"fields": [{"path": "a", "normalize": "upper"}]}', "unknown normalization 'upper' of 'a'"),
    ('{"fields": [{"path": "a"}], "on_missing": "skip"}', "unknown on_missing 'skip'"),
    ('{"fields": [{"path": "a", "from": "x[0].y"}]}', "invalid source path 'x[0].y' of 'a'"),
    ('{"fields": [{"path": "a"}], "include_provenance": 1}', "include_provenance must be true or false"),
    ("{", "no JSON"),
]
_SQL_TEXTS = "[" + ", ".join("NULL" if e is None else "'" + e.replace("'", "''") + "'" for _, e in _CONFIGS) + "]"
_PATHS = [("a.b_1", 1), ("a", 1), ("a[0]", 1), ("a.b[12]", 1), ("a[].b.c", 1), ("a[0].b", 0), ("1a", 0), ("a..b", 0), ("a b", 0), ("a[x]", 0), ("a[]", 0), ("", 0)]


@query(f"""
SELECT p_partkey, {_SQL_TEXTS}[p_partkey % {len(_CONFIGS)} + 1] AS error FROM part
""")
def config_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A config for each part; what is wrong with it."""
    config = F.element_at(F.array(*[F.lit(c) for c, _ in _CONFIGS]), (F.col("p_partkey") % len(_CONFIGS) + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", projection.config_errors(config).alias("error"))


@query(f"""
SELECT p_partkey, {[v for _, v in _PATHS]}[p_partkey % {len(_PATHS)} + 1] = 1 AS valid FROM part
""")
def path_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.element_at(F.array(*[F.lit(p) for p, _ in _PATHS]), (F.col("p_partkey") % len(_PATHS) + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", projection.valid_path(path).alias("valid"))


@query("""
SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN '+1415555' || lpad((c_custkey % 10000)::VARCHAR, 4, '0') ELSE 'none' END AS phone,
       'Python,React,' || lower(c_mktsegment) AS skills, 'React' AS best, c_acctbal AS overall_confidence, c_name AS provenance FROM customer
""")
def project_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields normalised, or kept where that fails; the two switches come last
    and win over projected fields of their names."""
    k = F.col("c_custkey")
    skills = F.array(F.lit("py"), F.lit(" reactjs"), F.lower("c_mktsegment"))
    rows = table(spark, sf_dir, "customer").select(
        k.alias("id"), F.when(k % 2 == 0, F.format_string("(415) 555-%04d", k % 10000)).otherwise("none").alias("phone"), skills.alias("skills"),
        F.col("c_acctbal").alias("overall_confidence"), F.col("c_name").alias("provenance"),
    )
    fields = [
        {"path": "overall_confidence", "from": "id"}, {"path": "id"}, {"path": "phone", "normalize": "E164"}, {"path": "skills", "normalize": "canonical"},
        {"path": "best", "from": "skills[1]", "normalize": "canonical"},
    ]
    out = projection.project(rows, projection.parse_config({"fields": fields}))
    return out.withColumn("skills", F.array_join("skills", ","))


@query("""
SELECT event_id, CASE WHEN event_id = lo THEN '[' ELSE '' END || '{"event_id":' || event_id || ',"user_id":' || user_id || '}' || CASE WHEN event_id = hi THEN ']' ELSE ',' END AS value
FROM (SELECT *, min(event_id) OVER () AS lo, max(event_id) OVER () AS hi FROM events)
""")
def json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as the lines of one JSON array."""
    rows = table(spark, sf_dir, "events").select("event_id", F.to_json(F.struct("event_id", "user_id")).alias("json"))
    return json_array(rows, F.col("event_id")).select(F.col("_order").alias("event_id"), "value")


# -- logs and audits -----------------------------------------------------------------


@query("""
SELECT event_id, ts FROM events ORDER BY ts DESC, event_id LIMIT 3
""")
def latest_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.latest(table(spark, sf_dir, "events"), "ts", 3, ("event_id",)).select("event_id", "ts")


@query("""
SELECT event_id, level, CASE WHEN contains(lower(props), '7') THEN strpos(lower(props), '7') ELSE 0 END::INTEGER AS mark
FROM (SELECT *, CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS level FROM events)
WHERE level = 'ERROR' AND (contains(lower(props), '7') OR contains(lower(user_id::VARCHAR), '7'))
""")
def log_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors that name a text in message or stage, and where it stands first."""
    rows = table(spark, sf_dir, "events").select(
        "event_id", F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO").alias("level"), F.col("props").alias("message"), F.col("user_id").cast("string").alias("stage")
    )
    return audit.log_filter(rows, "ERROR", "7").select("event_id", "level", audit.highlight(F.col("message"), "7").alias("mark"))


@query("""
SELECT c_custkey, (row_number() OVER (ORDER BY n COLLATE NOCASE DESC) - 1)::BIGINT AS place
FROM (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN lower(c_mktsegment) ELSE upper(c_mktsegment) END || lpad(c_custkey::VARCHAR, 9, '0') AS n FROM customer)
""")
def sorted_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each row once sorted by a column of mixed case, last first."""
    k, name = F.col("c_custkey"), F.col("c_mktsegment")
    mixed = F.concat(F.when(k % 2 == 0, F.lower(name)).otherwise(F.upper(name)), F.lpad(k.cast("string"), 9, "0"))
    rows = audit.sort(table(spark, sf_dir, "customer").select(k, mixed.alias("n")), "n", descending=True)
    rows = settle(rows.withColumn("row", F.monotonically_increasing_id()), "sorted")
    return ordered_totals(rows, [F.col("row")], {"place": F.lit(1)}).select("c_custkey", "place")


@query("""
SELECT 'INFO' AS level, 'documents' AS stage, 'rows=' || count(*) || ', long=' || count(*) FILTER (WHERE n_chars > 1000) AS message FROM documents
UNION ALL SELECT 'INFO', 'labelled', 'rows=' || count(*) FROM documents JOIN labels USING (doc_id)
UNION ALL SELECT 'WARN', 'nothing', 'rows=0'
""")
def run_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of the stages of a run, observed while they run, as log rows."""
    log = RunLog()
    docs = log.watch(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "documents", long=F.count_if(F.col("n_chars") > 1000))
    both = log.watch(settle(docs, "docs").join(table(spark, sf_dir, "labels"), "doc_id"), "labelled")
    settle(log.watch(settle(both, "both").filter("doc_id is null"), "nothing"), "nothing")
    return log.table(spark).select("level", "stage", "message")


@query("""
SELECT c_custkey AS seq, 'csv' AS source_type, c_name AS full_name, 'c' || c_custkey || '@x.org' AS emails FROM customer
UNION ALL SELECT s_suppkey, 'pdf', 'Ada Bo', 's' || s_suppkey || '@x.org' FROM supplier
""")
def record_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of a list and of texts, united as the readers' results are."""
    mail = lambda letter, key: F.concat(F.lit(letter), F.col(key).cast("string"), F.lit("@x.org"))
    rows = table(spark, sf_dir, "customer").select(
        F.lit("a.csv").alias("source_file"), F.col("c_custkey").alias("seq"), F.col("c_name").alias("full_name"), mail("c", "c_custkey").alias("email")
    )
    texts = table(spark, sf_dir, "supplier").select(
        F.lit("b.pdf").alias("source_file"), F.col("s_suppkey").alias("seq"), F.concat(F.lit("Ada Bo\n"), mail("s", "s_suppkey")).alias("text")
    )
    both = csv_source.records(rows).unionByName(extract.parse_resumes(texts))
    return both.select("seq", "source_type", "full_name", F.array_join("emails", ",").alias("emails"))
