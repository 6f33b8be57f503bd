"""Fields of resume texts, as expressions on one row.

Everything works on the array of a text's lines with higher-order functions, so
a text never leaves its row and nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold import constants as K
from kinfold.functions.skills import alias_map
from kinfold.functions.text import distinct_by, lines, once, split_clean, strip
from kinfold.schema import EDUCATION, EXPERIENCE, PROVENANCE

REGEX = K.BASE_CONFIDENCE["pdf"] * K.METHOD_FACTOR["regex"]
SECTION = K.BASE_CONFIDENCE["pdf"] * K.METHOD_FACTOR["section_heuristic"]


#: Finds what ``K.EMAIL`` finds, but tries a run of its characters once, not from each of them: a find starts where a run
#: does or the find before ended, and a run that no @ follows is not tried in parts.
EMAIL = rf"(?:\G|(?<!{K.EMAIL_LOCAL})){K.EMAIL_LOCAL}++@{K.EMAIL_HOST}"


def every(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def digits(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\D", "")


def emails(text: Column) -> Column:
    """Distinct addresses in the order of the text."""
    return F.array_distinct(every(text, EMAIL))


#: Find what the patterns of ``K`` find, but are tried only where one may start.
PHONE = r"(?U)(?=[+(\d])" + K.PHONE
LINKEDIN, GITHUB, URL = "(?=[hHwWlL])" + K.LINKEDIN, "(?=[hHwWgG])" + K.GITHUB, "(?=[hH])" + K.URL


def phones(text: Column) -> Column:
    """Finds with 7 to 15 digits, the first spelling of each digit string."""
    found = F.filter(F.transform(every(text, PHONE), strip), lambda x: F.length(digits(x)).between(7, 15))
    return distinct_by(found, digits)


def linkedin(text: Column) -> Column:
    return F.get(every(text, LINKEDIN), 0)


def github(text: Column) -> Column:
    return F.get(every(text, GITHUB), 0)


def other_urls(text: Column) -> Column:
    """Links to neither of the two networks; the first is the portfolio."""
    return F.filter(every(text, URL), lambda u: ~F.lower(u).contains("linkedin.com") & ~F.lower(u).contains("github.com"))


def person_name(rows: Column) -> Column:
    """The first of five lines that looks like a name."""
    keywords = [w for words in K.SECTION_KEYWORDS.values() for w in words]

    def named(x: Column) -> Column:
        words = F.regexp_count(x, F.lit(r"(?U)\S+"))
        ratio = F.length(F.regexp_replace(x, r"(?U)[^\p{L}\s]", "")) / F.greatest(F.length(x), F.lit(1))
        phone = x.rlike(PHONE) & (F.length(digits(x)) > 5)
        return ~x.rlike(K.NOT_NAME) & ~x.rlike(EMAIL) & ~phone & ~F.lower(x).isin(*keywords) & words.between(1, 5) & (ratio > 0.7)

    return F.get(F.filter(F.slice(rows, 1, 5), named), 0)


def place(rows: Column, name: Column) -> Column:
    """struct(city, region) from the first of six lines with a state code."""
    near = F.filter(F.slice(rows, 1, 6), lambda x: ~x.eqNullSafe(name) & x.rlike(K.STATE))
    parts = once(F.get(near, 0), lambda x: F.transform(F.split(x, "[|•·]"), strip))
    found = once(F.get(F.filter(parts, lambda s: s.rlike(K.STATE)), 0), lambda x: F.split(x, ","))

    def made(found: Column) -> Column:
        region = F.nullif(F.regexp_extract(F.get(found, 1), r"(?U)^\s*+(\S+)", 1), F.lit(""))
        town = once(strip(F.get(found, 0)), lambda c: F.when(~c.contains("@") & ~c.rlike(r"(?U)^\d+$"), c))
        return F.struct(town.alias("city"), region.alias("region"))

    return once(found, made)


def section_of(line: Column) -> Column:
    """Name of the section that a header line opens, else null: a keyword, with a run
    of edge characters before and behind it at most."""
    names = {w: name for name, words in K.SECTION_KEYWORDS.items() for w in words}
    edge = rf"\s*+(?:{K.HEADER_EDGE})?+\s*+"
    word = F.regexp_extract(F.lower(line), rf"(?U)^{edge}({'|'.join(names)}){edge}$", 1)
    return F.try_element_at(alias_map(names), word)


def section(rows: Column, heads: Column, name: str) -> Column:
    """Lines under the last header of that name (earlier ones are overwritten)."""
    at = F.array_max(F.transform(heads, lambda h, i: F.when(h == name, i)))

    def below(at: Column) -> Column:
        end = F.array_min(F.transform(heads, lambda h, i: F.when(h.isNotNull() & (i > at), i)))
        return F.when(at.isNotNull(), F.slice(rows, at + 2, F.coalesce(end, F.size(rows)) - at - 1))

    return once(at, below)


def skills(part: Column) -> Column:
    return F.filter(split_clean(F.array_join(part, " "), "[,|•·;]+"), lambda s: F.length(s).between(2, 49))


def _end(c: Column) -> Column:
    return F.when(~F.lower(c).isin("present", "current", "now"), c)


#: Whatever ``K.DATE_RANGE`` finds has four digits in a row, which is seen much sooner.
FOUR_DIGITS = r"(?U)\d{4}"


def experience(part: Column) -> Column:
    """Entries: lines with three parts or a date range, and the bullets below.
    Bullets above the first entry are its own.  What a line is, is found once."""
    line = lambda x: F.struct(x.alias("x"), x.rlike(K.ENTRY).alias("three"), (x.rlike(FOUR_DIGITS) & x.rlike(K.DATE_RANGE)).alias("dated"))
    start = lambda j: j["three"] | j["dated"]
    dated = r"(?s)^(.*?)" + K.DATE_RANGE

    def head(j: Column) -> Column:
        x = j["x"]
        before = F.split(F.regexp_replace(strip(F.regexp_extract(x, dated, 1)), "[-–—|•·]+$", ""), "[|•·–—]")
        none = F.lit(None).cast("string")
        part_of = lambda n: strip(F.regexp_extract(x, K.ENTRY, n))
        three = F.struct(part_of(2).alias("company"), part_of(1).alias("title"), part_of(3).alias("dates"))

        def two(b: Column) -> Column:
            first = strip(F.get(b, 0))
            company, title = F.when(F.size(b) >= 2, strip(F.get(b, 1))).otherwise(none), F.when((F.size(b) >= 2) | (first != ""), first).otherwise(none)
            return F.struct(company.alias("company"), title.alias("title"), x.alias("dates"))

        return F.when(j["three"], three).otherwise(once(before, two))

    def entry(jobs: Column, at: Column, i: Column, k: Column) -> Column:
        first = F.when(k == 0, F.lit(0)).otherwise(i)
        below = F.slice(jobs, first + 1, F.coalesce(F.get(at, k + 1), F.size(jobs)) - first)
        bullets = F.filter(below, lambda b: ~start(b) & b["x"].rlike(K.BULLET))
        bullets = F.transform(bullets, lambda b: strip(F.regexp_replace(b["x"], r"^[-•·–→▪► ]+", "")))

        def made(h: Column) -> Column:
            has = h["dates"].rlike(FOUR_DIGITS)
            group = lambda n: F.when(has, F.nullif(F.regexp_extract(h["dates"], K.DATE_RANGE, n), F.lit("")))
            return F.struct(
                h["company"].alias("company"), h["title"].alias("title"), group(1).alias("start"), once(group(2), _end).alias("end"),
                F.nullif(F.array_join(F.filter(bullets, lambda b: b != ""), " "), F.lit("")).alias("summary"),
            )

        return once(head(F.get(jobs, i)), made)

    def entries(jobs: Column) -> Column:
        at = F.filter(F.transform(jobs, lambda j, i: F.when(start(j), i)), lambda i: i.isNotNull())
        return once(at, lambda at: F.transform(at, lambda i, k: entry(jobs, at, i, k)))

    return once(F.transform(part, line), entries)


def education(part: Column) -> Column:
    """Entries: lines with a degree; the next line may name the institution."""
    words = "|".join(w.replace(".", r"\.") for w in K.DEGREE_KEYWORDS)
    line = lambda x: F.struct(x.alias("x"), F.lower(x).rlike(words).alias("degree"), F.nullif(F.regexp_extract(x, K.YEAR, 1), F.lit("")).alias("year"))
    bare = lambda x: F.regexp_replace(strip(x), r"[|,\- ]+$", "")
    no_year = lambda x: bare(F.regexp_replace(x, K.YEAR, ""))

    def entry(rows: Column, i: Column) -> Column:
        x, following = F.get(rows, i), F.get(rows, i + 1)
        other = following.isNotNull() & ~following["degree"]
        words = F.regexp_count(following["x"], F.lit(r"(?U)\S+"))
        return F.struct(
            F.when(other & following["year"].isNotNull(), no_year(following["x"])).when(other & (words <= 10), bare(following["x"])).alias("institution"),
            F.when(x["year"].isNotNull(), no_year(x["x"])).otherwise(strip(x["x"])).alias("degree"),
            F.lit(None).cast("string").alias("field"),
            F.coalesce(x["year"], F.when(other, following["year"])).alias("end_year"),
        )

    def entries(rows: Column) -> Column:
        at = F.filter(F.transform(rows, lambda x, i: F.when(x["degree"], i)), lambda i: i.isNotNull())
        return F.transform(at, lambda i: entry(rows, i))

    return once(F.transform(part, line), entries)


def provenance(marks: list[tuple[str, Column, str, float]], source: Column) -> Column:
    """Records (field, source, method, confidence) of the marks that hold, in order."""
    made = [
        F.when(holds, F.struct(F.lit(f).alias("field"), source.alias("source"), F.lit(m).alias("method"), F.lit(c).alias("confidence")))
        for f, holds, m, c in marks
    ]
    return F.filter(F.array(*made), lambda x: x.isNotNull()).cast(f"array<{PROVENANCE}>")


def parse_resumes(texts: DataFrame) -> DataFrame:
    """Records in the parsed schema from (source_file, seq, text); texts without
    any visible character give none."""
    some = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    rows = texts.filter(F.col("text").rlike(r"(?U)\S")).select("source_file", "seq", "text", lines(F.col("text")).alias("_lines"))
    rows = rows.withColumn("_heads", F.transform("_lines", section_of)).withColumn("full_name", person_name(F.col("_lines")))
    text, ls = F.col("text"), F.col("_lines")
    part = {n: section(ls, F.col("_heads"), n) for n in K.SECTION_KEYWORDS}
    rows = rows.withColumns(
        {f"_{n}": p for n, p in part.items()}
        | {"emails": emails(text), "phones": phones(text), "linkedin": linkedin(text), "github": github(text), "_urls": other_urls(text)}
        | {"_place": place(ls, F.col("full_name"))}
    )
    rows = rows.withColumns(
        {
            "skills": skills(F.col("_skills")), "experience": experience(F.col("_experience")),
            "education": education(F.col("_education")), "summary": F.nullif(strip(F.array_join("_summary", " ")), F.lit("")),
            "portfolio": F.get("_urls", F.lit(0)), "other_links": F.slice("_urls", F.lit(2), F.greatest(F.size("_urls"), F.lit(1))),
            "city": F.col("_place.city"), "region": F.col("_place.region"),
        }
    ).withColumn("years_experience", F.regexp_extract("summary", K.YEARS_OF, 1).try_cast("double"))
    c = F.col
    marks = [
        ("emails", some("emails"), "regex", REGEX), ("phones", some("phones"), "regex+phonenumbers", REGEX),
        ("links.linkedin", c("linkedin").isNotNull(), "regex", REGEX), ("links.github", c("github").isNotNull(), "regex", REGEX),
        ("links.portfolio", c("portfolio").isNotNull(), "regex", REGEX), ("full_name", c("full_name").isNotNull(), "section_heuristic", SECTION),
        ("skills", some("skills"), "section_heuristic", SECTION), ("experience", some("experience"), "section_heuristic", SECTION),
        ("education", some("education"), "section_heuristic", SECTION), ("summary", c("summary").isNotNull(), "section_heuristic", SECTION),
        ("years_experience", c("years_experience").isNotNull(), "regex", REGEX), ("location.city", c("city").isNotNull(), "regex", REGEX),
        ("location.region", c("region").isNotNull(), "regex", REGEX),
    ]
    none, empty = F.lit(None).cast("string"), F.array()
    return rows.select(
        F.lit("pdf").alias("source_type"), "source_file", "seq", "full_name", "emails", "phones", "city", "region",
        none.alias("country"), "linkedin", "github", "portfolio", "other_links", none.alias("headline"), none.alias("current_company"),
        "years_experience", F.coalesce("skills", empty.cast("array<string>")).alias("skills"),
        F.coalesce("experience", empty.cast(f"array<{EXPERIENCE}>")).alias("experience"),
        F.coalesce("education", empty.cast(f"array<{EDUCATION}>")).alias("education"),
        "summary", provenance(marks, c("source_file")).alias("provenance"),
    )
