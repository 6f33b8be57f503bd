"""Scalar functions against vectors."""

import random

import pytest
from pyspark.sql import functions as F

from kinfold import constants as K
from kinfold.errors import ConfigError
from kinfold.functions import contact, dates, ids, places, skills, text
from kinfold.operators import audit, extract, projection


def ev(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.o for r in df.select("i", f(F.col("v")).alias("o")).orderBy("i").collect()]


def test_phone(spark):
    cases = {
        "(415) 555-1234": "+14155551234", "+44 20 7946 0958": "+442079460958", "+91 98765 43210": "+919876543210", "+14155551234": "+14155551234",
        "415.555.1234 x12": "+14155551234", "1-415-555-1234": "+14155551234", "123": None, "not a number": None, "1234567890123456": None,
        "(115) 555-1234": None, "+1 115 555 1234": None, "": None, None: None,
    }
    assert ev(spark, list(cases), contact.normalize_phone) == list(cases.values())
    assert ev(spark, [["(415) 555-1234", "+1 415-555-1234", "x"]], contact.normalize_phones, "array<string>") == [["+14155551234"]]


def test_email(spark):
    cases = {
        "  User@Example.COM  ": "user@example.com", "first.last+label@domain.co.uk": "first.last+label@domain.co.uk", "not-an-email": None,
        "user@": None, "@domain.com": None, "a..b@x.org": None, "a@x": None, "a@-x.org": None, "": None, None: None,
    }
    assert ev(spark, list(cases), contact.normalize_email) == list(cases.values())
    assert ev(spark, [["A@x.org", "a@X.org", "no"], None], contact.normalize_emails, "array<string>") == [["a@x.org"], None]


def test_date(spark):
    cases = {
        "Jan 2024": "2024-01", "2024/02": "2024-02", "03-2024": "2024-03", "2024": "2024-01", "Present": None, "current": None, "garbage": None, "": None,
        "Sept. 2019": "2019-09", "January 5, 2020": "2020-01", "2020-03-15": "2020-03", "3/15/2020": "2020-03", "15/03/2020": "2020-03", "13/2024": None,
        "2024-13": None, "0000": "0000-01", "Summer 2019": None, "March": None, "may 2001": "2001-05", "Maybe 2001": None, None: None,
    }
    assert ev(spark, list(cases), dates.normalize_date) == list(cases.values())
    assert ev(spark, ["Present", " NOW ", "Jan 2024"], dates.is_ongoing) == [True, True, False]


def test_experience_dates_keep_what_they_cannot_read(spark):
    kind = "array<struct<company:string,title:string,start:string,end:string,summary:string>>"
    got = ev(spark, [[("a", "b", "Jan 2020", "Present", None), ("a", "b", "once", "2021", None), ("a", "b", None, None, None)]], dates.experience_dates, kind)
    assert [(e.start, e.end) for e in got[0]] == [("2020-01", None), ("once", "2021-01"), (None, None)]


def test_skills(spark):
    cases = {"ReactJS": "React", "react.js": "React", "NodeJS": "Node.js", " typescript\t": "TypeScript", "COBOL": "COBOL", "  ": None, None: None}
    assert ev(spark, list(cases), lambda c: skills.canonicalize_skill(c)) == list(cases.values())
    items = [["ReactJS", "react", "Python", "python3", "NodeJS", "React.js", "py"], ["React Native", "ReactNative", "react natives", "Go"], [], None]
    want = [["React", "Python", "Node.js"], ["React Native", "Go"], [], None]
    assert ev(spark, items, lambda c: skills.canonicalize_skills(c), "array<string>") == want


def ratio(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return 200.0 * t[-1][-1] / (len(a) + len(b)) if a or b else 100.0


def test_similarity_equals_brute_force(spark):
    pairs = [("react native", "reactnative"), ("abc", "cab"), ("", "x"), ("aaaa", "aa"), ("kubernetes", "kubernets"), ("", "")]
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", skills.similarity(F.col("a"), F.col("b")).alias("r"))
    assert all(abs(r.r - ratio(r.a, r.b)) < 1e-9 for r in df.collect())


def test_places(spark):
    cases = {"United States": "US", "USA": "US", "IN": "IN", "deu": "DE", "Kenya": "KE", " france ": "FR", "unknown place": None, "": None, None: None}
    assert ev(spark, list(cases), places.normalize_country) == list(cases.values())
    assert ev(spark, ["SF", "new york", "McLean", " ", None], places.normalize_city) == ["Sf", "New York", "McLean", "", None]


@pytest.mark.parametrize(("raw", "want"), [("o'BRIEN", "o'BRIEN"), ("O'BRIEN-SMITH 3RD", "O'Brien-Smith 3Rd"), ("ÉLAN", "Élan"), ("123", "123"), (" ada lovelace ", "Ada Lovelace")])
def test_title(spark, raw, want):
    assert ev(spark, [raw], text.title_if_flat) == [want]


def test_id_is_stable(spark):
    kind = "name string, mails array<string>, calls array<string>"
    rows = [("Ada ", ["b@x", "A@x"], ["+2", "+1"]), ("ada", ["a@x", "B@x"], ["+1", "+2"]), (None, None, None)]
    got = [r[0] for r in spark.createDataFrame(rows, kind).select(ids.entity_id(F.col("name"), F.col("mails"), F.col("calls"))).collect()]
    import hashlib

    assert got[0] == got[1] == hashlib.sha256(b"ada||a@x|b@x||+1|+2").hexdigest()
    assert got[2] == hashlib.sha256(b"||||").hexdigest()


def test_display(spark):
    assert ev(spark, [0.8742, 0.005, 0.0, 1.0, None], audit.percent, "double") == ["87%", "1%", "0%", "100%", None]
    assert ev(spark, ["2020-01", "", None], audit.end_shown) == ["2020-01", "Present", "Present"]


def test_config_from_a_file(spark, tmp_path):
    (tmp_path / "good.json").write_text('{"fields": [{"path": "a", "from": "emails[0]",\n "required": true}], "on_missing": "error"}')
    config = projection.load_config(spark, str(tmp_path / "good.json"))
    assert config.on_missing == "error" and config.fields[0].source == "emails[0]" and config.fields[0].required
    for name, text, says in (("bad.json", "{", "no JSON"), ("odd.json", '{"fields": []}', "field"), ("path.json", '{"fields": [{"path": "a b"}]}', "a b")):
        (tmp_path / name).write_text(text)
        with pytest.raises(ConfigError, match=says):
            projection.load_config(spark, str(tmp_path / name))
    with pytest.raises(ConfigError, match="cannot read"):
        projection.load_config(spark, str(tmp_path / "absent.json"))


def test_strip_takes_what_the_unicode_class_does(spark):
    """Every character of the basic plane that is white for the pattern, and no other."""
    rows = spark.range(1, 0xD800).union(spark.range(0xE000, 0x10000)).select(F.decode(F.unhex(F.format_string("%04X", "id")), "UTF-16BE").alias("c"))
    rows = rows.withColumn("t", F.concat("c", "c", F.lit("a"), "c", F.lit("b日"), "c"))
    plain = F.regexp_replace("t", r"(?U)^\s+|\s+$", "")
    assert rows.filter(~text.strip(F.col("t")).eqNullSafe(plain)).count() == 0 and rows.filter(plain != F.col("t")).count() == len(text.WHITE)
    blank = spark.createDataFrame([("",), (" \n\u3000",), (None,)], "t string").select(text.strip(F.col("t")).alias("s")).collect()
    assert [r.s for r in blank] == ["", "", None]


def test_patterns_that_start_late_find_the_same(spark):
    rng = random.Random(6)
    parts = ["http://", "HTTPS://", "www.", "WWW.", "linkedin.com/in/", "LinKedIn.com/in/", "lin\u212aedin.com/in/", "github.com/", "G\u0130THUB.com/", "g\u0131thub.com/", "ab-c", "/", " ", ",", "+1 ", "(415) ", "555", "-", "1234", "\u0664\u0661\u0665", ".", "\u017f"]
    rows = spark.createDataFrame([("".join(rng.choices(parts, k=rng.randrange(14))),) for _ in range(5000)], "t string")
    for plain, own in ((K.PHONE, extract.PHONE), (K.LINKEDIN, extract.LINKEDIN), (K.GITHUB, extract.GITHUB), (K.URL, extract.URL)):
        a, b = (extract.every(F.col("t"), p) for p in (plain, own))
        assert rows.filter(~a.eqNullSafe(b)).count() == 0 and rows.filter(F.size(a) > 0).count() > 100
