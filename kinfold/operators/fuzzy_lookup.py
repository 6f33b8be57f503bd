"""Misspelt names looked up in a list of names, by deletion neighbourhoods.

Two strings that differ by a substitution, an insertion, a deletion or two swapped
letters become equal when one letter of each (or of the longer) is deleted.  So the
list is indexed by what is left of each name after up to ``k`` deletions, and a
misspelt value is joined by equality with the same of its own, instead of being
compared with every name.  Only distinct values that are in question are expanded;
the list has a fixed size, and its index is broadcast.

Defined results: values shorter than ``SHORT`` letters and null ones find nothing;
longer ones may differ by one deletion, those from ``LONG`` letters on by two; the
fewest deletions win, then the smallest edit distance, and a tie between two codes
finds nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.constants import COUNTRY_ALIASES
from kinfold.functions.places import iso_names, normalize_country
from kinfold.functions.text import clean

from .names import fresh
from .salting import heavy_join
from .scratch import settle

SHORT, LONG = 4, 8


def _shorter(s: Column) -> Column:
    """All strings with one letter less."""
    left = lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substr(s, i + 1))
    return F.when(F.length(s) > 0, F.transform(F.sequence(F.lit(1), F.length(s)), left)).otherwise(F.array().cast("array<string>"))


def _marked(deleted: int):
    return lambda rest: F.struct(F.lit(deleted).alias("deleted"), rest.alias("rest"))


def neighbourhood(s: Column, most: int = 2) -> Column:
    """Array of struct(deleted, rest): the strings left after up to ``most``
    deletions, each with the fewest that lead there (rests of equal length)."""
    rests, out = F.array(s), F.array(F.struct(F.lit(0).alias("deleted"), s.alias("rest")))
    for k in range(1, most + 1):
        rests = F.array_distinct(F.flatten(F.transform(rests, _shorter)))
        marked = F.transform(rests, _marked(k))
        out = F.concat(out, F.when(F.length(s) >= (SHORT if k == 1 else LONG), marked).otherwise(F.filter(marked, lambda x: F.lit(False))))
    return out


def lookup(values: DataFrame, names: DataFrame, value: str = "value") -> DataFrame:
    """(value, code) of the distinct ``values`` that resolve against ``names``
    (name, code); both are compared as they are, so bring them to one case."""
    own = values.select(F.col(value).alias("value")).distinct().filter(F.length("value") >= SHORT)
    known = names.select("name", "code", F.explode(neighbourhood(F.col("name"))).alias("y"))
    known = known.select("name", "code", F.col("y.deleted").alias("less"), F.col("y.rest").alias("rest"))
    asked = own.select("value", F.explode(neighbourhood(F.col("value"))).alias("x")).select("value", F.col("x.deleted").alias("deleted"), F.col("x.rest").alias("rest"))
    met = asked.join(F.broadcast(known), "rest")
    rank = F.struct(F.greatest("deleted", "less").alias("deleted"), F.levenshtein("value", "name").alias("distance"))
    met = met.groupBy("value", "code").agg(F.min(rank).alias("rank"))
    best = met.groupBy("value").agg(F.min("rank").alias("best"), F.collect_set(F.struct("rank", "code")).alias("all"))  # at most as many as the list has codes
    codes = F.filter("all", lambda x: x["rank"] == F.col("best"))
    return best.select("value", F.when(F.size(codes) == 1, codes[0]["code"]).alias("code")).filter("code is not null")


def country_names(spark: SparkSession) -> DataFrame:
    """(name, code): English names of countries and the aliases, no codes."""
    known = {n: c for n, c in (iso_names() | COUNTRY_ALIASES).items() if len(n) >= SHORT}
    return spark.createDataFrame(sorted(known.items()), "name string, code string")


def resolved(rows: DataFrame, names: DataFrame, value: str, into: str) -> DataFrame:
    """``rows`` with ``into``: the code that the value resolves to, or null.  Rows
    without a value, or with a short one, take part in no join, and a value that
    very many rows share stays where it is."""
    (count,) = fresh([*rows.columns, into], "count")
    long = F.coalesce(F.length(F.col(value)), F.lit(0)) >= SHORT
    asked = settle(rows.filter(long), "asked")
    sizes = asked.groupBy(value).agg(F.count("*").alias(count))
    found = lookup(sizes, names, value).select(F.col("value").alias(value), F.col("code").alias(into))
    found = settle(found.join(sizes, value), "resolved")
    out = heavy_join(asked, found, [value], count, asked.count(), "left").drop(count)
    return out.unionByName(rows.filter(~long).withColumn(into, F.lit(None).cast("string")))


def with_country(rows: DataFrame, column: str = "country") -> DataFrame:
    """``rows`` with the column's countries as alpha-2 codes, misspelt names
    included; only what is no alias, code or name is looked up."""
    raw, known, code = fresh(rows.columns, "raw", "known", "code")
    marked = rows.withColumn(known, normalize_country(F.col(column)))
    marked = marked.withColumn(raw, F.when(F.col(known).isNull(), F.lower(clean(F.col(column)))))
    out = resolved(marked, country_names(rows.sparkSession), raw, code)
    return out.withColumn(column, F.coalesce(known, code)).select(*rows.columns)
