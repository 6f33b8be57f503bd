"""From files to projected profiles, as one chain of DataFrame stages."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.errors import ProjectionError, SourceError, ValidationError
from kinfold.functions.contact import normalize_emails, normalize_phones
from kinfold.functions.dates import experience_dates
from kinfold.functions.places import normalize_city, normalize_country, normalize_region
from kinfold.functions.skills import canonicalize_skills
from kinfold.functions.text import title_if_flat
from kinfold.operators.confidence import active, from_scores
from kinfold.operators.fuzzy_lookup import with_country
from kinfold.operators.identity import EMAIL, NAME, entities
from kinfold.operators.merge import merged
from kinfold.operators.prefix import ordered_totals
from kinfold.operators.projection import Config, asks_provenance, project, to_json
from kinfold.operators.scratch import delete, settle
from kinfold.operators.validate import validate, watched
from kinfold.schema import PARSED, ddl
from kinfold.sources import csv, resume  # noqa: F401  both register their readers
from kinfold.sources.manifest import listing, manifest, reader_of


def read_sources(spark: SparkSession, paths: Iterable[str]) -> DataFrame:
    """Records of all sources, in the order given."""
    kinds = manifest(paths)
    if not kinds:
        raise SourceError("no sources given")
    made = [reader_of(kind)(spark, files) for kind, files in kinds.items()]
    made = [d for d in made if d is not None]
    return reduce(DataFrame.unionByName, made) if made else spark.createDataFrame([], ddl(PARSED))


def read_folder(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(records of all sources below a folder, in order of their paths;
    (path, reason) of the files that gave none).  The list of files is a table: no
    file costs a step on the driver, and a broken one costs itself only.  Empty files
    are not listed."""
    files = listing(spark, folder)
    made, odd = [], [files.filter("kind is null").select("path", F.lit("unknown kind of source").alias("reason"))]
    for read in (csv.read_listed, resume.read_listed):
        records, without = read(spark, folder, files)
        made += [records] if records is not None else []
        odd.append(without)
    return reduce(DataFrame.unionByName, made), reduce(DataFrame.unionByName, odd)


def normalize(records: DataFrame, misspelt: bool = False) -> DataFrame:
    """All fields normalised; provenance stays, also of values that became null.
    With ``misspelt``, countries that are no known name are looked up by their
    nearest one, which needs a join."""
    records = with_country(records) if misspelt else records
    return records.withColumns(
        {
            "emails": normalize_emails(F.col("emails")),
            "phones": normalize_phones(F.col("phones")),
            "skills": canonicalize_skills(F.col("skills")),
            "country": normalize_country(F.col("country")),
            "city": normalize_city(F.col("city")),
            "region": normalize_region(F.col("region")),
            "full_name": title_if_flat(F.col("full_name")),
            "experience": experience_dates(F.col("experience")),
        }
    )


def profiles(records: DataFrame, match_on: tuple[str, ...] = (EMAIL, NAME), provenance: bool = True) -> DataFrame:
    """Canonical profiles with confidence, from normalised records; without
    ``provenance`` that array is neither gathered nor a column."""
    rows = settle(records, "records")  # read by the links and by each merge rule
    found = settle(entities(rows, match_on), "entities")
    return from_scores(merged(found, provenance=provenance, scores=tuple(active())))


def transform(spark: SparkSession, paths: Iterable[str], config: Config, match_on: tuple[str, ...] = (EMAIL, NAME)) -> DataFrame:
    """Projected and validated profiles of the sources, in order of first record."""
    found = profiles(normalize(read_sources(spark, paths), misspelt=True), match_on, asks_provenance(config))
    out = project(settle(found, "profiles").orderBy("component"), config)  # checks and sink read what is merged once
    return validate(out, config)


def json_array(rows: DataFrame, order: Column, json: str = "json") -> DataFrame:
    """Lines ``value`` of one JSON array in a total order: each object with what
    stands around it, so that the part files put together are the array."""
    total = F.lit(rows.count())
    placed = ordered_totals(rows.withColumn("_order", order), [F.col("_order")], {"_place": F.lit(1)})
    head, tail = F.when(F.col("_place") == 0, "[").otherwise(""), F.when(F.col("_place") == total - 1, "]").otherwise(",")
    return placed.select("_order", F.concat(head, json, tail).alias("value"))


def write_json(rows: DataFrame, config: Config, path: str, array: bool = False) -> None:
    """One JSON object a line, in parallel files; with ``array``, the lines of
    one JSON array over the files in order of their names."""
    lines = to_json(rows, config)
    if array:
        numbered = settle(lines.withColumn("_row", F.monotonically_increasing_id()), "lines")
        lines = json_array(numbered, F.col("_row")).orderBy("_order").select("value")
        if numbered.isEmpty():
            lines = rows.sparkSession.createDataFrame([("[]",)], "value string")
    lines.write.mode("overwrite").text(path)


def export(spark: SparkSession, paths: Iterable[str], config: Config, path: str, array: bool = False, match_on: tuple[str, ...] = (EMAIL, NAME)) -> None:
    """From sources to JSON: profiles are merged, projected, checked and written
    in one pass.  Rules that rows break are counted on the way; if there are any,
    the output is deleted and the error names them with their counts.  Profiles
    are in order of first record only in an array, which needs a sort."""
    found = profiles(normalize(read_sources(spark, paths), misspelt=True), match_on, asks_provenance(config))
    found = settle(found, "profiles").orderBy("component") if array else found  # a sort samples its rows first
    rows, watch = watched(project(found, config, check=False), config)
    write_json(rows, config, path, array)
    try:
        watch.check()
    except (ProjectionError, ValidationError):
        delete(spark, path)
        raise
