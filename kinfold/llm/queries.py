"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.operators.spread import spread

from . import bpe, collocations, exact_dedup, fill_in_middle, mixing, near_dedup, permutation_index, pseudonyms, sharding, token_counts, toxicity, url_filter, word_table


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text) of all documents, for work on whole texts."""
    return spread(_table(spark, sf_dir, "documents").select("doc_id", "text"))


TOKEN_LIMIT = 1024
MIX_WEIGHTS, MIX_CAP = [1.0, 2.0, 3.0], 3.0
SHARDS = 24
#: A deployment passes its own secret.
PSEUDONYM_KEY = "registered-query"
RULES = [
    url_filter.Rule("net", "/", False),
    url_filter.Rule("example.net", "/en/", True),
    url_filter.Rule("example.com", "/de/", False),
    url_filter.Rule("org", "/fr/", True),
]


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(_texts(spark, sf_dir))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _texts(spark, sf_dir)
    path = public_tokenizers.path("byte_bpe_50k.json")
    return token_counts.counted(docs, path, public_tokenizers.PATTERN, TOKEN_LIMIT, keep=["doc_id"])


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"), MIX_WEIGHTS, MIX_CAP)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = exact_dedup.DigestIndex(spark, f"digests_{uuid.uuid4().hex}")
    done = exact_dedup.dedup(_table(spark, sf_dir, "documents"), index)
    index.drop()  # the decisions are settled
    return done


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages"), RULES, keep=["page_id"])


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _texts(spark, sf_dir)
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.round_trip(docs, path, public_tokenizers.PATTERN, keep=["doc_id"])


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _texts(spark, sf_dir)
    lexicon = toxicity.learn(docs, _table(spark, sf_dir, "labels"), ~toxicity.held_out(F.col("doc_id")))
    held = toxicity.held_out(F.col("doc_id")).alias("held_out")
    return toxicity.judge(docs, lexicon).select("doc_id", held, "score", "predicted")


def op8_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = pseudonyms.pseudonymise(_texts(spark, sf_dir), PSEUDONYM_KEY)
    return done.select("doc_id", "text", "n_pii", *[f"n_{k}" for k in pseudonyms.KINDS])


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation_index.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"), SHARDS)


def op11_word_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _texts(spark, sf_dir)
    return word_table.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, keep=["doc_id"])


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(spread(_table(spark, sf_dir, "documents").select("lang", "text")), least=30, top=2000, percent=80)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.digested(_texts(spark, sf_dir), seed=7)


QUERIES = [
    op1_near_dedup, op2_token_counts, op3_source_mix, op4_exact_dedup, op5_url_filter, op6_bpe, op7_toxicity,
    op8_pseudonyms, op9_nearest, op10_sharding, op11_word_table, op12_collocations, op13_fill_in_middle,
]


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         (('0x' || substr(md5('mix:' || doc_id), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         ((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::DOUBLE AS w
  FROM d GROUP BY source),
c AS (
  SELECT *, 3.0 * source_size::DOUBLE AS cap, sum(source_size) OVER ()::DOUBLE AS total FROM s),
l AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
    / sum(w) OVER (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM c),
f AS (SELECT max(level) AS level FROM l WHERE level * w <= cap),
t AS (
  SELECT source, source_size, CASE WHEN f.level IS NULL THEN cap ELSE least(cap, f.level * w) END AS target
  FROM l LEFT JOIN f ON true),
e AS (
  SELECT d.*, source_size, target,
         CASE WHEN source_size > 0 THEN least(target * (1.0 / source_size), 3.0) ELSE 0.0 END AS expected
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (SELECT *, floor(expected + 1e-9) AS sure, greatest(expected - floor(expected + 1e-9), 0.0) AS p FROM e),
q AS (
  SELECT *, sum(sure * size) OVER (PARTITION BY source) AS given,
         CASE WHEN p > 1e-9 THEN (u / (1 - u)) / (p / (1 - p)) END AS odds FROM p),
r AS (
  SELECT *, coalesce(sum(CASE WHEN odds IS NOT NULL THEN size ELSE 0 END) OVER (
    PARTITION BY source ORDER BY odds NULLS LAST, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM q)
SELECT doc_id, size, source_size, target,
       ((sure + CASE WHEN odds IS NOT NULL AND size > 0 AND before + size / 2 <= target - given THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM r
"""

DEDUP_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(translate(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS text_sha256
  FROM documents),
g AS (
  SELECT text_sha256, arg_min(doc_id, (-n, doc_id)) AS keep_id, count(*)::BIGINT AS group_size FROM d GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""

URL_SQL = r"""
WITH a AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS tail FROM pages),
h AS (
  SELECT page_id, regexp_extract(tail, '^[^/?#]*') AS raw, tail FROM a),
p AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(tail, length(raw) + 1), '^[^?#]*') AS path FROM h),
r AS (
  SELECT *, CASE
    WHEN ends_with('.' || host, '.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN ends_with('.' || host, '.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN ends_with('.' || host, '.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN ends_with('.' || host, '.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM p)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM r
"""


PHRASE_SQL = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM d),
g AS (
  SELECT lang, size, unnest([array_to_string(words[i:i + size - 1], ' ') FOR i IN range(1, len(words) - size + 2)]) AS phrase
  FROM w, (VALUES (1), (2), (3), (4)) t(size) WHERE len(words) >= size),
f AS (SELECT lang, size, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang),
c AS (SELECT lang, size, phrase, f, string_split(phrase, ' ') AS words FROM f WHERE size > 1 AND f >= 30),
k AS (
  SELECT lang, phrase, f, cut, array_to_string(words[1:cut], ' ') AS first, array_to_string(words[cut + 1:], ' ') AS rest
  FROM (SELECT *, unnest(range(1, size)) AS cut FROM c)),
s AS (
  SELECT k.lang, k.phrase, k.f AS a, l.f AS l, r.f AS r, ((2000000::HUGEINT * k.f) // (l.f + r.f))::BIGINT AS score
  FROM k JOIN f l ON l.lang = k.lang AND l.phrase = k.first JOIN f r ON r.lang = k.lang AND r.phrase = k.rest
  QUALIFY row_number() OVER (PARTITION BY k.lang, k.phrase ORDER BY score, cut) = 1),
i AS (
  SELECT lang, part, max(f) AS within
  FROM (SELECT lang, f, unnest(flatten([[array_to_string(words[j:j + m - 1], ' ') FOR j IN range(1, size - m + 2)] FOR m IN range(2, size)])) AS part FROM c WHERE size > 2)
  GROUP BY lang, part),
t AS (
  SELECT s.* FROM s LEFT JOIN i ON i.lang = s.lang AND i.part = s.phrase
  WHERE within IS NULL OR 100::HUGEINT * within < 80::HUGEINT * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM t JOIN n USING (lang) QUALIFY rank <= 2000
"""

FIM_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || doc_id) AS h,
         regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units FROM documents),
k AS (
  SELECT *, len(units)::BIGINT AS n, ('0x' || h[1:8])::BIGINT % (len(units) + 1) AS one, ('0x' || h[9:16])::BIGINT % (len(units) + 1) AS two,
         ('0x' || h[17:24])::BIGINT % 100 AS chance, ('0x' || h[25:32])::BIGINT % 100 AS side FROM d),
p AS (
  SELECT doc_id, n, text,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR chance >= 100 THEN 'plain'
              WHEN side < 50 THEN 'spm' ELSE 'psm' END AS form,
         array_to_string(units[1:least(one, two)], '') AS prefix,
         array_to_string(units[least(one, two) + 1:greatest(one, two)], '') AS middle,
         array_to_string(units[greatest(one, two) + 1:], '') AS suffix FROM k)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_source_mix": MIX_SQL, "op4_exact_dedup": DEDUP_SQL, "op5_url_filter": URL_SQL, "op12_collocations": PHRASE_SQL, "op13_fill_in_middle": FIM_SQL}
