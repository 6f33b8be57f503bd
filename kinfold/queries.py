"""The library's operators applied to the driver's tables, and their SQL.

The tables hold no resumes, so each query applies one operator to columns that
look alike.  All queries read their tables whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold import constants as K
from kinfold.functions import contact, dates, ids, number_plan, places, skills, text
from kinfold.operators import audit, components, confidence, extract, fuzzy_lookup, identity, merge, near_names, projection, validate
from kinfold.operators.scratch import settle
from kinfold.operators.spread import spread
from kinfold.plans.pipeline import normalize, profiles
from kinfold.sources import csv as csv_source
from kinfold.sources.manifest import kind_column

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sql_list(items) -> str:
    return "[" + ", ".join("'" + str(i).replace("'", "''") + "'" for i in items) + "]"


def _sql_map(pairs: dict[str, str]) -> str:
    return f"MAP({_sql_list(pairs)}, {_sql_list(pairs.values())})"


RAW_SKILLS = list(K.SKILL_ALIASES)
_SQL_SPACE = r"[\s\x0b\x{1c}-\x{1f}\x{85}\p{Z}]"
_RE2_PHONE = K.PHONE.removeprefix("(?U)")


# -- extraction ------------------------------------------------------------------


@query(rf"""
SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '{K.EMAIL}')) AS email FROM documents
""")
def extract_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(extract.emails(F.col("text"))).alias("email"))


@query(rf"""
SELECT doc_id, digits FROM (
  SELECT DISTINCT doc_id, regexp_replace(unnest(regexp_extract_all(text, '{_RE2_PHONE}')), '[^0-9]', '', 'g') AS digits FROM documents)
WHERE length(digits) BETWEEN 7 AND 15
""")
def extract_phones(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select("doc_id", F.explode(extract.phones(F.col("text"))).alias("p"))
    return found.select("doc_id", F.regexp_replace("p", "[^0-9]", "").alias("digits"))


@query(rf"""
WITH e AS (
  SELECT doc_id, lower(unnest(regexp_extract_all(text, '{K.EMAIL}'))) AS email FROM documents)
SELECT doc_id, count(DISTINCT email)::INTEGER AS n, string_agg(DISTINCT email, ',' ORDER BY email) AS emails
FROM e WHERE regexp_full_match(email, '[a-z0-9!#$%&''*+/=?^_`{{|}}~-]+(\.[a-z0-9!#$%&''*+/=?^_`{{|}}~-]+)*@([a-z0-9]([a-z0-9-]{{0,61}}[a-z0-9])?\.)+[a-z][a-z0-9-]*[a-z0-9]')
GROUP BY doc_id
""")
def normalize_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select("doc_id", contact.normalize_emails(extract.emails(F.col("text"))).alias("e"))
    return found.filter(F.size("e") > 0).select("doc_id", F.size("e").alias("n"), F.array_join(F.array_sort("e"), ",").alias("emails"))


@query(rf"""
WITH p AS (
  SELECT doc_id, regexp_replace(unnest(regexp_extract_all(text, '{_RE2_PHONE}')), '[^0-9+]', '', 'g') AS p FROM documents)
SELECT DISTINCT doc_id, '+1' || regexp_extract(p, '^(?:\+?1)?([2-9]\d{{2}}[2-9]\d{{6}})$', 1) AS phone
FROM p WHERE regexp_matches(p, '^(\+1|1)?[2-9]\d{{2}}[2-9]\d{{6}}$') AND NOT regexp_matches(right(p, 10), '^(.9|.11|200|300|400|37|555|96|....11)')
""")
def normalize_phones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All valid numbers of the documents in E.164; the SQL knows those of the
    North American plan only, and the tables hold no others."""
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(contact.normalize_phones(extract.phones(F.col("text")))).alias("phone"))


_DIAL = """CASE c_custkey % 4 WHEN 0 THEN '1' || lpad((c_custkey * 7919 % 1000)::VARCHAR, 3, '2') || lpad((c_custkey * 104729 % 10000000)::VARCHAR, 7, '5')
  WHEN 1 THEN (c_custkey * 31 % 990 + 1)::VARCHAR || repeat('4', (c_custkey % 13)::INTEGER) WHEN 2 THEN '44' || lpad(c_custkey::VARCHAR, (6 + c_custkey % 6)::INTEGER, '2')
  ELSE '1' || lpad((c_custkey * 7919 % 800 + 200)::VARCHAR, 3, '2') || '5551234' END"""


@query(f"""
WITH plan(prefix, least, most) AS (VALUES {", ".join(f"('{p}', {a}, {b})" for p, a, b in number_plan.default_plan().entries)}),
d AS (SELECT c_custkey, {_DIAL} AS digits FROM customer),
m AS (
  SELECT c_custkey, digits, max((length(prefix), least, most)) AS hit
  FROM d JOIN plan ON starts_with(digits, prefix) GROUP BY c_custkey, digits)
SELECT d.c_custkey, '+' || m.digits AS phone FROM d LEFT JOIN m ON m.c_custkey = d.c_custkey
  AND length(m.digits) BETWEEN hit[2] AND hit[3] AND NOT regexp_matches(m.digits, '{K.NORTH_AMERICAN["no_exchange"]}')
""")
def planned_phones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of many calling and area codes against the plan: the SQL looks up
    the longest prefix in a table of the same entries."""
    k = F.col("c_custkey")
    text, pad = lambda c: c.cast("string"), lambda c, n, by: F.lpad(c.cast("string"), n, by)
    local = F.concat(F.lit("1"), pad(k * 7919 % 1000, 3, "2"), pad(k * 104729 % 10000000, 7, "5"))
    abroad = F.concat(text(k * 31 % 990 + 1), F.expr("repeat('4', cast(c_custkey % 13 as int))"))
    britain = F.concat(F.lit("44"), F.expr("lpad(cast(c_custkey as string), cast(6 + c_custkey % 6 as int), '2')"))
    area = F.concat(F.lit("1"), pad(k * 7919 % 800 + 200, 3, "2"), F.lit("5551234"))
    digits = F.element_at(F.array(local, abroad, britain, area), (k % 4 + 1).cast("int"))
    return table(spark, sf_dir, "customer").select("c_custkey", contact.normalize_phone(F.concat(F.lit("+"), digits)).alias("phone"))


@query(rf"""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
u AS (SELECT doc_id, unnest(ls) AS raw, generate_subscripts(ls, 1) AS i FROM l),
s AS (SELECT doc_id, i, regexp_replace(regexp_replace(raw, '^{_SQL_SPACE}+', ''), '{_SQL_SPACE}+$', '') AS line FROM u)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INTEGER AS pos, line FROM s WHERE line <> ''
""")
def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(text.lines(F.col("text"))).alias("pos", "line"))


@query(r"""
WITH l AS (SELECT page_id, url, CASE page_id % 3 WHEN 0 THEN ' https://www.linkedin.com/in/p-' || page_id WHEN 1 THEN ' github.com/p_' || page_id || '/' ELSE '' END AS extra FROM pages)
SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'https://www.linkedin.com/in/p-' || page_id END AS linkedin,
       CASE WHEN page_id % 3 = 1 THEN 'github.com/p_' || page_id || '/' END AS github,
       nullif(regexp_extract(url, '(?i)https?://[^\s,;|]+'), '') AS portfolio
FROM l
""")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of a line that holds the page's url and, for some, a profile."""
    id = F.col("page_id").cast("string")
    extra = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit(" https://www.linkedin.com/in/p-"), id)).when(
        F.col("page_id") % 3 == 1, F.concat(F.lit(" github.com/p_"), id, F.lit("/"))
    )
    line = F.concat(F.col("url"), F.coalesce(extra, F.lit("")))
    return table(spark, sf_dir, "pages").select(
        "page_id", extract.linkedin(line).alias("linkedin"), extract.github(line).alias("github"),
        F.get(extract.other_urls(line), 0).alias("portfolio"),
    )


@query("""
SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'csv' WHEN 1 THEN 'pdf' END AS kind FROM pages
""")
def source_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    suffix = F.element_at(F.array(*map(F.lit, (".csv", ".PDF", ".txt", ""))), (F.col("page_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", kind_column(F.concat(F.col("url"), F.lit("/file"), suffix)).alias("kind"))


@query("""
WITH s AS (
  SELECT conv_id, arg_max(text, turn) FILTER (WHERE role = 'user') AS u, arg_max(text, turn) FILTER (WHERE role = 'assistant') AS a
  FROM conversations GROUP BY conv_id)
SELECT conv_id, md5(replace(u, chr(10), ' ')) AS summary, md5(replace(a, chr(10), ' ')) AS experience FROM s
""")
def section_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation as a resume: a turn's role is a header, its text the line below."""
    head = F.when(F.col("role") == "user", "PROFILE:").when(F.col("role") == "assistant", "- Work History -").otherwise("contact")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array(head, F.replace("text", F.lit("\n"), F.lit(" "))).alias("ls"))
    rows = turns.groupBy("conv_id").agg(F.flatten(merge.gathered(F.col("turn"), F.col("ls"))).alias("ls"))
    rows = rows.withColumn("heads", F.transform("ls", extract.section_of))
    part = {n: F.md5(F.array_join(extract.section(F.col("ls"), F.col("heads"), n), " ")) for n in ("summary", "experience")}
    return rows.select("conv_id", *[c.alias(n) for n, c in part.items()])


@query()
def resume_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All extraction rules over the documents as resume texts."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    docs = docs.select(F.concat(F.col("source"), F.lit(".pdf")).alias("source_file"), F.col("doc_id").alias("seq"), "text")
    return extract.parse_resumes(docs).select(
        "seq", "full_name", "city", "region", "portfolio", F.size("emails").alias("n_emails"), F.size("phones").alias("n_phones"),
        F.size("skills").alias("n_skills"), F.size("experience").alias("n_jobs"), F.size("education").alias("n_degrees"),
        F.size("provenance").alias("n_marks"),
    )


# -- scalar functions ------------------------------------------------------------


def _raw_skill(key: Column) -> Column:
    name = F.element_at(F.array(*map(F.lit, RAW_SKILLS)), (F.pmod(key, F.lit(len(RAW_SKILLS))) + 1).cast("int"))
    return F.when(key % 2 == 0, F.concat(F.lit("  "), F.upper(name), F.lit("\t"))).otherwise(name)


@query(f"""
WITH r AS (SELECT p_partkey, p_name, {_sql_list(RAW_SKILLS)}[(p_partkey % {len(RAW_SKILLS)} + 1)::INTEGER] AS raw FROM part)
SELECT p_partkey, {_sql_map(K.SKILL_ALIASES)}[raw] AS skill, p_name AS other FROM r
""")
def alias_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known aliases get their canonical names, part names stay."""
    return table(spark, sf_dir, "part").select(
        "p_partkey", skills.canonicalize_skill(_raw_skill(F.col("p_partkey"))).alias("skill"),
        skills.canonicalize_skill(F.concat(F.lit(" "), "p_name")).alias("other"),
    )


@query(f"""
WITH r AS (
  SELECT l_orderkey, (l_linenumber, l_partkey) AS o, {_sql_map(K.SKILL_ALIASES)}[{_sql_list(RAW_SKILLS)}[(l_partkey % {len(RAW_SKILLS)} + 1)::INTEGER]] AS s
  FROM lineitem),
d AS (SELECT l_orderkey, lower(s) AS k, arg_min(s, o) AS s, min(o) AS o FROM r GROUP BY l_orderkey, lower(s))
SELECT l_orderkey, count(*)::INTEGER AS n, string_agg(s, '|' ORDER BY o) AS skills FROM d GROUP BY l_orderkey
""")
def canonical_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    out = skills.canonical_rows(rows, "l_orderkey", F.struct("l_linenumber", "l_partkey"), _raw_skill(F.col("l_partkey")))
    return out.select("l_orderkey", F.size("skills").alias("n"), F.array_join("skills", "|").alias("skills"))


@query("""
WITH RECURSIVE r AS (
  SELECT l_orderkey AS g, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS o, p_name || ' ' || p_brand AS name
  FROM lineitem JOIN part ON l_partkey = p_partkey),
u AS (SELECT g, min(o) AS o, arg_min(name, o) AS name FROM r GROUP BY g, lower(name)),
s AS (SELECT g, row_number() OVER (PARTITION BY g ORDER BY o) AS k, name, lower(name) AS low FROM u),
p AS (SELECT DISTINCT a.low AS x, b.low AS y FROM s a JOIN s b ON a.g = b.g AND a.k < b.k WHERE levenshtein(a.low, b.low) <= 0.1 * (length(a.low) + length(b.low))),
m AS (
  SELECT x, y, (1::HUGEINT << length(x)) - 1 AS every,
         [list_sum([CASE WHEN x[i] = y[j] THEN 1::HUGEINT << (i - 1) ELSE 0 END FOR i IN range(1, length(x) + 1)])::HUGEINT FOR j IN range(1, length(y) + 1)] AS hits FROM p),
c AS (SELECT x, y, length(x) - bit_count(list_reduce(hits, lambda s, h: ((s + (s & h)) | (s - (s & h))) & every, every)) AS common FROM m),
e AS (
  SELECT b.g, b.k, list(a.k) AS earlier FROM s a JOIN s b ON a.g = b.g AND a.k < b.k JOIN c ON c.x = a.low AND c.y = b.low
  WHERE 200.0 * common / (length(a.low) + length(b.low)) >= 90 GROUP BY b.g, b.k),
w AS (
  SELECT DISTINCT g, 0::BIGINT AS k, []::BIGINT[] AS kept FROM s
  UNION ALL
  SELECT w.g, w.k + 1, CASE WHEN coalesce(list_has_any(w.kept, e.earlier), false) THEN w.kept ELSE list_append(w.kept, w.k + 1) END
  FROM w JOIN s ON s.g = w.g AND s.k = w.k + 1 LEFT JOIN e ON e.g = w.g AND e.k = w.k + 1),
d AS (SELECT g, arg_max(kept, k) AS kept FROM w GROUP BY g),
n AS (SELECT g, count(*) AS n_raw FROM r GROUP BY g)
SELECT d.g AS l_orderkey, any_value(n_raw)::INTEGER AS n_raw, string_agg(name, '|' ORDER BY s.k) AS kept
FROM d JOIN n ON n.g = d.g JOIN s ON s.g = d.g AND list_contains(d.kept, s.k) GROUP BY d.g
""")
def fuzzy_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names of an order without those nearly equal to an earlier one."""
    named = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_brand").alias("name"))
    named, near, large = near_names.classed(named, "name")
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").filter("l_orderkey is not null")
    rows = items.join(named, F.col("l_partkey") == F.col("p_partkey")).withColumn("o", F.struct("l_linenumber", "l_partkey"))
    kept = near_names.kept_groups(rows, "l_orderkey", "o", "name", near, large, near_names.heavy_groups(items, "l_orderkey"))
    return kept.select("l_orderkey", F.col("n").cast("int").alias("n_raw"), F.array_join("kept.name", "|").alias("kept"))


@query("""
SELECT o_orderkey, CASE o_orderkey % 6 WHEN 5 THEN NULL WHEN 4 THEN strftime(o_orderdate, '%Y') || '-01' ELSE strftime(o_orderdate, '%Y-%m') END AS month
FROM orders
""")
def date_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 6
    shown = (
        F.when(k == 0, F.date_format(d, "MMM yyyy")).when(k == 1, F.date_format(d, "MM/yyyy")).when(k == 2, F.date_format(d, "yyyy-M"))
        .when(k == 3, F.date_format(d, "'  'MMMM d, yyyy")).when(k == 4, F.date_format(d, "yyyy")).otherwise(F.lit("Present"))
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.normalize_date(shown).alias("month"))


@query("""
SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) || ' O''Brien-Smith 3Rd'
  WHEN 1 THEN upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) || ' O''Brien-Smith 3Rd' WHEN 2 THEN c_name ELSE '123 #' END AS name
FROM customer
""")
def title_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw, k = F.concat(F.col("c_mktsegment"), F.lit(" o'BRIEN-smith 3rd ")), F.col("c_custkey") % 4
    name = F.when(k == 0, F.upper(raw)).when(k == 1, F.lower(raw)).when(k == 2, F.col("c_name")).otherwise(F.lit(" 123 #"))
    return table(spark, sf_dir, "customer").select("c_custkey", text.title_if_flat(name).alias("name"))


@query("""
SELECT n_nationkey, CASE n_nationkey % 5 WHEN 0 THEN 'US' WHEN 1 THEN 'GB' WHEN 2 THEN 'DE' WHEN 3 THEN 'JP' END AS country, count(c_custkey)::BIGINT AS customers
FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey
""")
def country_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spellings of countries of the customers' nations: aliases, codes, names."""
    spelled = F.element_at(F.array(*map(F.lit, (" U.S.A. ", "england", "DEU", "Japan"))), (F.col("n_nationkey") % 5 + 1).cast("int"))
    raw = F.when(F.col("n_nationkey") % 5 < 4, spelled).otherwise(F.col("n_name"))
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "customer"), F.col("n_nationkey") == F.col("c_nationkey"), "left")
    return rows.groupBy("n_nationkey", places.normalize_country(raw).alias("country")).agg(F.count("c_custkey").alias("customers"))


_MISSPELT = """CASE c_custkey % 7 WHEN 0 THEN lower(n_name) WHEN 1 THEN lower(substr(n_name, 1, 1) || substr(n_name, 3))
  WHEN 2 THEN lower(substr(n_name, 1, 2) || substr(n_name, 4, 1) || substr(n_name, 3, 1) || substr(n_name, 5)) WHEN 3 THEN lower(n_name) || 'x'
  WHEN 4 THEN lower(substr(n_name, 1, 1) || 'q' || substr(n_name, 3, 2) || 'z' || substr(n_name, 6)) WHEN 5 THEN 'planet ' || c_custkey ELSE NULL END"""


@query(f"""
WITH v AS (SELECT c_custkey, {_MISSPELT} AS value FROM customer JOIN nation ON n_nationkey = c_nationkey),
s AS (SELECT DISTINCT value AS s, 1 AS side FROM v WHERE length(value) >= 4 UNION ALL SELECT lower(n_name), 2 FROM nation),
one AS (SELECT DISTINCT s, side, s[1:i - 1] || s[i + 1:] AS rest FROM (SELECT *, unnest(range(1, length(s) + 1)) AS i FROM s) WHERE length(s) >= 4),
two AS (SELECT DISTINCT s, side, rest[1:i - 1] || rest[i + 1:] AS rest FROM (SELECT *, unnest(range(1, length(rest) + 1)) AS i FROM one) WHERE length(s) >= 8),
a AS (SELECT s, side, 0 AS deleted, s AS rest FROM s UNION ALL SELECT s, side, 1, rest FROM one UNION ALL SELECT s, side, 2, rest FROM two),
m AS (
  SELECT x.s AS value, y.s AS name, min((greatest(x.deleted, y.deleted), levenshtein(x.s, y.s))) AS rank
  FROM a x JOIN a y ON x.rest = y.rest AND x.side = 1 AND y.side = 2 GROUP BY ALL),
c AS (SELECT m.value, m.name, m.rank, min(m.rank) OVER (PARTITION BY m.value) AS best FROM m),
d AS (SELECT value, min(name) AS name FROM c WHERE rank = best GROUP BY value HAVING count(*) = 1)
SELECT v.c_custkey, d.name AS nation FROM v LEFT JOIN d ON d.value = v.value
""")
def misspelt_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations of the customers from misspelt names: letters left out, swapped,
    added, replaced, and names that are none."""
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(F.broadcast(nations), F.col("n_nationkey") == F.col("c_nationkey"))
    rows = rows.select("c_custkey", F.expr(_MISSPELT).alias("value"))
    names = nations.select(F.lower("n_name").alias("name"), F.lower("n_name").alias("code"))
    return fuzzy_lookup.resolved(rows, names, "value", "nation").select("c_custkey", "nation")


@query("""
SELECT c_custkey, sha256(lower(c_name) || '||' || 'a' || c_custkey || '@x.org|' || lower(n_name) || '@example.com' || '||' || CASE WHEN c_custkey % 2 = 0 THEN '+1' || c_custkey ELSE '' END) AS id
FROM customer JOIN nation ON n_nationkey = c_nationkey
""")
def entity_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    mails = F.array(F.concat(F.lit(" "), F.col("n_name"), F.lit("@EXAMPLE.com")), F.concat(F.lit("A"), F.col("c_custkey").cast("string"), F.lit("@x.org")))
    calls = F.when(F.col("c_custkey") % 2 == 0, F.array(F.concat(F.lit("+1"), F.col("c_custkey").cast("string"))))
    return rows.select("c_custkey", ids.entity_id(F.concat(F.lit(" "), "c_name"), mails, calls).alias("id"))


# -- identity --------------------------------------------------------------------


@query(r"""
WITH RECURSIVE k AS (
  SELECT doc_id, 't' || md5(text) AS key FROM documents UNION SELECT doc_id, 'l' || md5(string_split(text, chr(10))[1]) FROM documents),
h AS (SELECT key, min(doc_id) AS a FROM k GROUP BY key),
e AS (SELECT DISTINCT a, doc_id AS b FROM k JOIN h USING (key) WHERE a <> doc_id),
ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT b, c FROM r JOIN ways ON ways.a = r.doc_id)
SELECT doc_id, min(c) AS component FROM r GROUP BY doc_id
""")
def identity_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that share their text or first line, and all that these reach."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    first = F.get(F.split("text", "\n", 2), 0)
    keys = F.array(F.concat(F.lit("t"), F.md5("text")), F.concat(F.lit("l"), F.md5(first)))
    pairs = settle(docs.select("doc_id", F.explode(keys).alias("key")).filter("key is not null"), "keys")
    found = components.connected_components(identity.hub_links(pairs, "doc_id"))
    out = docs.select("doc_id").join(found, F.col("doc_id") == F.col("node"), "left")
    return out.select("doc_id", F.coalesce("component", "doc_id").alias("component"))


@query("""
SELECT min(doc_id) AS first_id, count(*)::BIGINT AS copies, md5(text) AS digest FROM documents GROUP BY text
""")
def dedup_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("digest"))
    return rows.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"))


# -- merging ---------------------------------------------------------------------


@query("""
WITH o AS (
  SELECT *, (CASE o_orderstatus WHEN 'F' THEN -100 WHEN 'O' THEN -80 ELSE 0 END, o_orderkey) AS ord,
         CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority END AS pri, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END AS price FROM orders)
SELECT o_custkey, arg_min(pri, ord) FILTER (WHERE pri IS NOT NULL) AS pri, arg_min(price, ord) FILTER (WHERE price IS NOT NULL) AS price
FROM o GROUP BY o_custkey
""")
def merge_scalar_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("o_orderstatus") == "F", "pdf").when(F.col("o_orderstatus") == "O", "csv")
    rows = table(spark, sf_dir, "orders").select(
        "o_custkey", kind.alias("source_type"), F.col("o_orderkey").alias("seq"),
        F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderpriority")).alias("pri"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice")).alias("price"),
    )
    return merge.merge_scalars(merge.ordered(rows), ("pri", "price"), "o_custkey")


@query("""
WITH e AS (SELECT user_id, event_id, CASE WHEN event_id % 2 = 0 THEN upper(event_type) ELSE event_type END AS v FROM events),
d AS (SELECT user_id, lower(v) AS k, arg_min(v, event_id) AS v, min(event_id) AS o FROM e GROUP BY user_id, lower(v))
SELECT user_id, string_agg(v, '|' ORDER BY o) AS types FROM d GROUP BY user_id
""")
def merge_list_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.when(F.col("event_id") % 2 == 0, F.upper("event_type")).otherwise(F.col("event_type"))
    rows = table(spark, sf_dir, "events").select("user_id", F.lit("csv").alias("source_type"), F.col("event_id").alias("seq"), F.array(v).alias("types"))
    return merge.merge_lists(merge.ordered(rows), ("types",), "user_id").select("user_id", F.array_join("types", "|").alias("types"))


@query("""
WITH p AS (
  SELECT o_custkey, lower(o_orderpriority) AS k, o_orderkey AS o, o_orderpriority AS title,
         CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus WHEN o_orderkey % 3 = 1 THEN '' END AS company,
         CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice::VARCHAR END AS summary FROM orders),
m AS (
  SELECT o_custkey, k, min(o) AS o, arg_min(title, o) AS title, arg_min(company, o) FILTER (WHERE company <> '') AS company,
         arg_min(o, o) FILTER (WHERE summary IS NOT NULL) AS summary_of FROM p GROUP BY o_custkey, k)
SELECT o_custkey, string_agg(title || ':' || coalesce(company, '-') || ':' || coalesce(summary_of::VARCHAR, '-'), '|' ORDER BY o) AS jobs FROM m GROUP BY o_custkey
""")
def merge_nested_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of one priority are one entry; gaps are filled from later ones."""
    k = F.col("o_orderkey")
    entry = F.struct(
        F.when(k % 3 == 0, F.col("o_orderstatus")).when(k % 3 == 1, "").alias("company"), F.col("o_orderpriority").alias("title"),
        F.when(k % 5 == 0, k.cast("string")).alias("summary"),
    )
    rows = table(spark, sf_dir, "orders").select("o_custkey", F.lit("csv").alias("source_type"), k.alias("seq"), F.array(entry).alias("jobs"))
    out = merge.merge_entries(merge.ordered(rows), "jobs", ("company", "title", "summary"), ("title",), "o_custkey")
    shown = F.transform("jobs", lambda j: F.concat_ws(":", j["title"], F.coalesce(j["company"], F.lit("-")), F.coalesce(j["summary"], F.lit("-"))))
    return out.select("o_custkey", F.array_join(shown, "|").alias("jobs"))


@query("""
WITH r AS (SELECT l_suppkey, p_brand, lower(p_brand) AS k, l_returnflag AS src, min(l_orderkey * 10 + l_linenumber) AS o FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL)
SELECT l_suppkey, arg_min(p_brand, o) AS skill, count(*)::INTEGER AS n_sources, string_agg(src, ',' ORDER BY src) AS sources,
       CASE count(*) WHEN 1 THEN 0.8 WHEN 2 THEN 0.85 ELSE 0.9 END::DOUBLE AS confidence
FROM r GROUP BY l_suppkey, k
""")
def skill_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands of a supplier as skills, return flags as sources."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    rows = rows.select(
        "l_suppkey", F.lit("csv").alias("source_type"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
        F.col("l_returnflag").alias("source_file"), F.array("p_brand").alias("skills"),
        F.array().cast("array<struct<field:string,source:string,method:string,confidence:double>>").alias("provenance"),
    )
    out = merge.merge_skills(merge.ordered(rows), "l_suppkey").select("l_suppkey", F.explode("skills").alias("s"))
    return out.select(
        "l_suppkey", F.col("s.name").alias("skill"), F.size("s.sources").alias("n_sources"), F.array_join(F.array_sort("s.sources"), ",").alias("sources"),
        F.col("s.confidence").alias("confidence"),
    )


@query("""
WITH n AS (SELECT o_custkey, o_orderstatus AS f, count(*) AS n, min((CASE o_orderstatus WHEN 'F' THEN -100 ELSE -80 END, o_orderkey)) AS o FROM orders GROUP BY ALL),
a AS (SELECT o_custkey, sum(n) AS n, arg_min(f, o) AS winner, count(DISTINCT CASE f WHEN 'F' THEN 100 ELSE 80 END) AS ranks, list(f ORDER BY o)[2:] AS losers FROM n GROUP BY o_custkey)
SELECT o_custkey, winner, array_to_string(losers, ',') AS losers,
       CASE WHEN n = 1 THEN 'single source' WHEN ranks = 2 THEN 'priority: 100 > 80' WHEN winner = 'F' THEN 'priority: 100' ELSE 'priority: 80' END AS reason
FROM a
""")
def merge_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which order status wins a customer's price, and over which others."""
    kind = F.when(F.col("o_orderstatus") == "F", "pdf").otherwise("csv")
    rows = table(spark, sf_dir, "orders").select("o_custkey", kind.alias("source_type"), F.col("o_orderkey").alias("seq"), F.col("o_orderstatus").alias("source_file"), "o_totalprice")
    out = merge.merge_decisions(merge.ordered(rows), ("o_totalprice",), "o_custkey")
    return out.select("o_custkey", F.col("winner_source").alias("winner"), F.array_join("loser_sources", ",").alias("losers"), "reason")


@query("""
SELECT c_custkey AS key, 'customer' AS source, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM customer
UNION ALL SELECT s_suppkey, 'supplier', s_name, s_acctbal, NULL FROM supplier
""")
def union_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("key"), F.lit("customer").alias("source"), F.col("c_name").alias("name"),
        F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"),
    )
    s = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("key"), F.lit("supplier").alias("source"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")
    )
    return c.unionByName(s, allowMissingColumns=True)


# -- confidence ------------------------------------------------------------------


@query("""
WITH e AS (SELECT user_id, event_type AS field, json_extract_string(props, '$.k') AS source, value / 1000 AS c FROM events)
SELECT user_id, field, least(max(c) + 0.03::DOUBLE * (count(DISTINCT source) - 1)::DOUBLE, 1.0::DOUBLE) AS score FROM e GROUP BY user_id, field
""")
def field_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(
        "user_id", F.col("event_type").alias("field"), F.get_json_object("props", "$.k").alias("source"), (F.col("value") / 1000).alias("confidence")
    )
    return confidence.field_confidence(rows, ["user_id", "field"])


@query("""
WITH d AS (
  SELECT d.doc_id, CASE WHEN quality IS NOT NULL THEN 0.5 + quality * 0.25 END AS q, CASE WHEN n_chars > 1000 THEN 0.875 END AS n, CASE WHEN lang = 'en' THEN 0.75 ELSE 0.0 END AS l
  FROM documents d LEFT JOIN labels USING (doc_id))
SELECT doc_id, CASE WHEN q IS NULL AND n IS NULL AND l = 0 THEN 0.0 ELSE
  (coalesce(q, 0) * 3.0 + coalesce(n, 0) * 2.0 + l * 1.0) / ((q IS NOT NULL)::INT * 3.0 + (n IS NOT NULL)::INT * 2.0 + (l > 0)::INT * 1.0) END AS overall
FROM d
""")
def weighted_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    scores = {
        "full_name": F.when(F.col("quality").isNotNull(), 0.5 + F.col("quality") * 0.25),
        "emails": F.when(F.col("n_chars") > 1000, F.lit(0.875)), "headline": F.when(F.col("lang") == "en", 0.75).otherwise(0.0),
    }
    return rows.select("doc_id", confidence.weighted(scores).alias("overall"))


# -- projection and validation -----------------------------------------------------


def _nested_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        merge.gathered(
            F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"),
            F.struct(F.col("l_partkey").cast("string").alias("part"), F.struct(F.col("l_returnflag").alias("flag")).alias("status")),
        ).alias("items")
    )
    rows = table(spark, sf_dir, "orders").join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    who = F.struct(F.col("o_custkey").cast("string").alias("id"), F.when(F.col("o_orderkey") % 2 == 0, "").otherwise(F.col("o_orderstatus")).alias("mark"))
    return rows.select("o_orderkey", who.alias("customer"), F.coalesce("items", F.array().cast(items.schema["items"].dataType)).alias("items"))


_PATHS = projection.parse_config(
    {
        "fields": [
            {"path": "o_orderkey"}, {"path": "who", "from": "customer.id", "type": "string", "required": True}, {"path": "mark", "from": "customer.mark"},
            {"path": "parts", "from": "items[].part", "type": "string[]"}, {"path": "flags", "from": "items[].status.flag"},
            {"path": "none", "from": "no.such.path"}, {"path": "first", "from": "items[0]", "type": "object"},
        ],
        "include_confidence": False, "include_provenance": False,
    }
)


@query("""
WITH i AS (
  SELECT l_orderkey, string_agg(l_partkey::VARCHAR, ',' ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS parts,
         string_agg(l_returnflag, ',' ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS flags,
         arg_min(l_partkey, (l_linenumber, l_partkey, l_suppkey, l_extendedprice))::VARCHAR AS first FROM lineitem GROUP BY l_orderkey)
SELECT o_orderkey, o_custkey::VARCHAR AS who, CASE WHEN o_orderkey % 2 = 1 THEN o_orderstatus END AS mark, parts, flags, NULL::VARCHAR AS none, first
FROM orders LEFT JOIN i ON l_orderkey = o_orderkey
""")
def project_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dotted, indexed, plucked, renamed and unknown paths over nested orders."""
    out = projection.project(_nested_orders(spark, sf_dir), _PATHS)
    return out.select(
        "o_orderkey", "who", "mark", F.array_join("parts", ",").alias("parts"), F.array_join("flags", ",").alias("flags"), "none",
        F.col("first.part").alias("first"),
    )


@query("""
SELECT event_id, '{"id":' || event_id || CASE WHEN k % 2 = 0 THEN ',"k":"' || k || '"' ELSE '' END || ',"kind":' || CASE WHEN event_type = 'error' THEN 'null' ELSE '"' || event_type || '"' END || '}' AS json
FROM (SELECT event_id, event_type, json_extract_string(props, '$.k')::INT AS k FROM events)
""")
def project_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Optional fields that are missing are left out, required ones show null."""
    k = F.get_json_object("props", "$.k")
    rows = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.when(k.try_cast("int") % 2 == 0, k).otherwise("").alias("k"),
        F.when(F.col("event_type") != "error", F.col("event_type")).alias("kind"),
    )
    config = projection.parse_config(
        {"fields": [{"path": "id"}, {"path": "k"}, {"path": "kind", "required": True}], "on_missing": "omit", "include_confidence": False, "include_provenance": False}
    )
    out = projection.project(rows, config)
    return projection.to_json(out, config).select(F.get_json_object("json", "$.id").cast("long").alias("event_id"), "json")


@query("""
SELECT doc_id, 'quality: required' AS violation FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL
UNION ALL SELECT doc_id, 'lang: not number' FROM documents WHERE lang IS NOT NULL
UNION ALL SELECT doc_id, 'marks: null element' FROM documents LEFT JOIN labels USING (doc_id) WHERE toxic IS NULL
""")
def validate_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each rule that a document breaks."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    rows = rows.withColumn("marks", F.array(F.col("toxic").cast("string")))
    config = projection.parse_config(
        {"fields": [{"path": "quality", "type": "number", "required": True}, {"path": "lang", "type": "number"}, {"path": "marks", "type": "string[]"}]}
    )
    return validate.violations(rows, config).select("doc_id", "violation")


@query("""
SELECT event_id, event_type, CASE WHEN value / 100 >= 0.9 THEN 'high' WHEN value / 100 >= 0.75 THEN 'medium' ELSE 'low' END AS tier
FROM events WHERE contains(lower(event_type), 'i') OR contains(lower(props), '7')
""")
def audit_search_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = audit.search(table(spark, sf_dir, "events"), "I", ["event_type"]).unionByName(
        audit.search(table(spark, sf_dir, "events").filter(~F.contains(F.lower("event_type"), F.lit("i"))), "7", ["props"])
    )
    return audit.sort(rows, "event_type", descending=True).select("event_id", "event_type", audit.tier(F.col("value") / 100).alias("tier"))


@query("""
SELECT p_partkey, CASE WHEN length(n) > 28 THEN substr(n, 1, 25) || '...' ELSE n END AS label, p_size || ' B' AS small
FROM (SELECT *, p_name || ', ' || p_brand || ' | ' || p_type || ' finish' AS n FROM part)
""")
def display_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat("p_name", F.lit(","), "p_brand", F.lit("|"), "p_type", F.lit("   finish"))
    return table(spark, sf_dir, "part").select("p_partkey", audit.short(audit.spaced(raw)).alias("label"), audit.byte_size(F.col("p_size")).alias("small"))


# -- records and profiles ----------------------------------------------------------


def _customer_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("list"), (k % 3).cast("string"), F.lit(".csv")).alias("source_file"), k.alias("seq"),
        F.concat(F.lit(" "), "c_name").alias("full_name"), F.concat(F.lit("C"), F.floor(k / 2).cast("string"), F.lit("@Example.com ")).alias("email"),
        F.when(k % 4 == 0, F.format_string("(415) 555-%04d", k % 10000)).alias("phone"), F.lit("  ").alias("city"),
        F.when(k % 2 == 0, "BERLIN, BE, germany").otherwise("Paris").alias("location"),
        F.when(k % 5 == 0, F.lit("n/a")).otherwise((k % 30).cast("string")).alias("years_experience"),
        F.concat(F.lit("ReactJS, "), F.lower("c_mktsegment"), F.lit(",,py")).alias("skills"),
    )


@query("""
SELECT c_custkey AS seq, c_name AS full_name, 'c' || c_custkey // 2 || '@example.com' AS email, CASE WHEN c_custkey % 4 = 0 THEN '+1415555' || lpad((c_custkey % 10000)::VARCHAR, 4, '0') END AS phone,
       CASE WHEN c_custkey % 2 = 0 THEN 'Berlin' ELSE 'Paris' END AS city, CASE WHEN c_custkey % 2 = 0 THEN 'DE' END AS country,
       CASE WHEN c_custkey % 5 > 0 THEN (c_custkey % 30)::DOUBLE END AS years, 'React|' || lower(c_mktsegment) || '|Python' AS skills,
       (4 + (c_custkey % 4 = 0)::INT + 2 * (c_custkey % 2 = 0)::INT + (c_custkey % 5 > 0)::INT)::INTEGER AS n_marks
FROM customer
""")
def csv_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as recruiter rows: cleaned, split, normalised, with provenance."""
    rows = normalize(csv_source.records(_customer_cells(spark, sf_dir)))
    return rows.select(
        "seq", "full_name", F.get("emails", F.lit(0)).alias("email"), F.get("phones", F.lit(0)).alias("phone"), "city", "country",
        F.col("years_experience").alias("years"), F.array_join("skills", "|").alias("skills"), F.size("provenance").alias("n_marks"),
    )


@query()
def entity_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer rows and document texts as two kinds of sources, merged by
    e-mail or name into canonical profiles with confidence and projected."""
    lists = csv_source.records(_customer_cells(spark, sf_dir))
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select(
        F.concat(F.col("source"), F.lit(".pdf")).alias("source_file"), (F.col("doc_id") + (1 << 40)).alias("seq"), "text"
    )
    config = projection.parse_config(
        {
            "fields": [
                {"path": "candidate_id", "required": True}, {"path": "full_name"}, {"path": "primary_email", "from": "emails[0]"},
                {"path": "phone", "from": "phones[0]", "normalize": "E164"}, {"path": "country", "from": "location.country"},
                {"path": "skills", "from": "skills[].name", "type": "string[]", "normalize": "canonical"},
            ],
            "include_provenance": False,
        }
    )
    records = normalize(lists.unionByName(extract.parse_resumes(docs)))
    found = profiles(records, provenance=projection.asks_provenance(config))
    out = projection.project(found, config)
    return out.withColumn("skills", F.array_join("skills", "|"))


@query("""
WITH c AS (SELECT c_custkey // 2 AS e, min(c_custkey) AS component, count(*)::BIGINT AS records FROM customer GROUP BY c_custkey // 2)
SELECT component, records FROM c
""")
def entity_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers that share an e-mail address."""
    rows = normalize(csv_source.records(_customer_cells(spark, sf_dir)))
    return identity.entities(rows, (identity.EMAIL,)).groupBy("component").agg(F.count("*").alias("records"))


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
SELECT doc_id, count(*)::BIGINT AS n_lines, sum(length(x))::BIGINT AS n_chars, arg_max(i, (length(x), -i))::BIGINT - 1 AS longest FROM l GROUP BY doc_id
""")
def line_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of a document's lines, as the run metrics of a text scan."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "x"))
    best = F.max_by("i", F.struct(F.length("x"), -F.col("i"))).cast("long")
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum(F.length("x")).cast("long").alias("n_chars"), best.alias("longest"))


@query("""
SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS start, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL
""")
def windowed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinfold.streaming.incremental import windowed_counts

    return windowed_counts(table(spark, sf_dir, "events")).withColumn("total", F.round("total", 4))


@query("""
SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS r FROM events) WHERE r <= 3
""")
def latest_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three latest log rows of each user."""
    return audit.latest(table(spark, sf_dir, "events"), "ts", 3, ("event_id",), ("user_id",)).select("user_id", "event_id")
