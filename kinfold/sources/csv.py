"""CSV records with headers under many names.

Files are read in splits, whether or not quoted cells hold line breaks (see
``csv_splits``); where the session sets ``kinfold.csv.multiLine`` to false, a quote
never reaches over a line.  The first scan gives the headers as well, as a table
with a row a file; each row's cells are picked by the positions that the header of
its file has, which come along in a join with the splits.
"""

from __future__ import annotations

import csv
from io import StringIO

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from kinfold import constants as K
from kinfold.errors import MalformedCsv, SourceError
from kinfold.functions.text import clean, split_clean, strip
from kinfold.operators.extract import provenance
from kinfold.operators.scratch import settle
from kinfold.schema import EDUCATION, EXPERIENCE

from . import csv_splits
from .manifest import ROWS, file_column, files_table, register

CONFIDENCE = K.BASE_CONFIDENCE["csv"] * K.METHOD_FACTOR["structured_field"]
COLUMNS = sorted(set(K.HEADER_ALIASES.values()))


def mapping(header: list[str], path: str = "") -> dict[str, int]:
    """Canonical column -> position; of several headers the last one counts."""
    found = {K.HEADER_ALIASES[h.strip().lower()]: i for i, h in enumerate(header) if h.strip().lower() in K.HEADER_ALIASES}
    if header and not found:
        raise MalformedCsv(f"{path} has no recognizable columns")
    return found


def records(rows: DataFrame) -> DataFrame:
    """Records in the parsed schema from canonical string columns plus
    source_file and seq; columns that are not there count as null."""
    cell = {name: clean(F.col(name)) if name in rows.columns else F.lit(None).cast("string") for name in set(K.HEADER_ALIASES.values())}
    rows = rows.select("source_file", "seq", *[c.alias(n) for n, c in sorted(cell.items())])
    c = F.col
    parts = F.when(c("city").isNull() & c("location").isNotNull(), F.transform(F.split("location", ","), strip))
    rows = rows.withColumn("_parts", parts)
    for i, name in enumerate(("city", "region", "country")):
        rows = rows.withColumn(name, F.coalesce(F.get("_parts", F.lit(i)), c(name)))
    number = F.when(c("years_experience").rlike(r"^[+-]?(?:[0-9][0-9_]*\.?[0-9_]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"), F.replace("years_experience", F.lit("_"), F.lit("")))
    rows = rows.withColumn("years_experience", number.try_cast("double")).withColumn("skills", split_clean(c("skills"), ","))
    one = lambda n: F.when(c(n).isNotNull(), F.array(n)).otherwise(F.array().cast("array<string>"))
    fields = [
        ("full_name", "full_name"), ("emails", "email"), ("phones", "phone"), ("location.city", "city"), ("location.region", "region"),
        ("location.country", "country"), ("links.linkedin", "linkedin"), ("links.github", "github"), ("links.portfolio", "portfolio"),
        ("headline", "headline"), ("current_company", "current_company"), ("years_experience", "years_experience"),
    ]
    marks: list[tuple[str, Column, str, float]] = [(f, c(n).isNotNull(), "structured_field", CONFIDENCE) for f, n in fields]
    marks.append(("skills", F.coalesce(F.size("skills"), F.lit(0)) > 0, "structured_field", CONFIDENCE))
    empty = F.array()
    return rows.select(
        F.lit("csv").alias("source_type"), "source_file", "seq", "full_name", one("email").alias("emails"), one("phone").alias("phones"),
        "city", "region", "country", "linkedin", "github", "portfolio", empty.cast("array<string>").alias("other_links"), "headline",
        "current_company", "years_experience", F.coalesce("skills", empty.cast("array<string>")).alias("skills"),
        empty.cast(f"array<{EXPERIENCE}>").alias("experience"), empty.cast(f"array<{EDUCATION}>").alias("education"),
        F.lit(None).cast("string").alias("summary"), provenance(marks, c("source_file")).alias("provenance"),
    )


def _positions(header: str) -> tuple[list[int | None] | None, int]:
    """(position of each canonical column, cells of the header); no positions if
    no name is known."""
    cells = next(csv.reader(StringIO(header, newline="")), [])
    try:
        found = mapping(cells)
    except MalformedCsv:
        return None, len(cells)
    return [found.get(c) for c in COLUMNS], len(cells)


def shapes(splits: DataFrame) -> DataFrame:
    """(path, header_place, where, width): positions of the canonical columns in each file with
    a header, from the first records of the files."""

    @F.pandas_udf("where array<int>, width int")
    def read_header(headers: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_positions(h) for h in headers], columns=["where", "width"], dtype=object)

    heads = splits.filter("start = 0 and header <> ''")
    return heads.select("path", "header_place", read_header("header").alias("h")).select("path", "header_place", "h.where", "h.width")


def _multiline(spark: SparkSession) -> bool:
    return spark.conf.get("kinfold.csv.multiLine", "true").lower() != "false"


def _records(rows: DataFrame, maps: DataFrame, found: DataFrame, numbers: DataFrame) -> DataFrame | None:
    """Records of the files with ``shapes``, in order of their ``numbers``
    (_path, _number); None if there is none."""
    many, width = _multiline(rows.sparkSession), found.agg(F.max("width")).first()[0]
    if width is None:
        return None
    numbers = numbers.withColumnRenamed("_path", "_bare")
    splits = csv_splits.split_states(maps).drop("header_place").join(found.drop("width"), "path").join(numbers, file_column(F.col("path")) == F.col("_bare"))
    splits = settle(splits.select("path", "start", "inside", "crossed", "where", "header_place", "_number"), "splits")
    cut = csv_splits.records(rows, splits, many).join(F.broadcast(splits.select("path", "start", "where", "header_place", "_number")), ["path", "start"])
    cut = cut.filter(~((F.col("start") == 0) & (F.col("place") <= F.col("header_place"))) & (F.trim("value", F.lit(" \t\r\n")) != ""))
    schema = ", ".join(f"c{k} string" for k in range(width))
    parsed = F.from_csv(csv_splits.without_return(F.col("value")), schema, {"multiLine": "true", "escape": '"', "mode": "PERMISSIVE", "maxColumns": str(max(width, 20480))})
    cells = cut.withColumn("_parsed", parsed).withColumn("_cells", F.array(*[F.col(f"_parsed.c{k}") for k in range(width)]))
    named = [F.get("_cells", F.get("where", F.lit(j))).alias(c) for j, c in enumerate(COLUMNS)]
    name = F.regexp_extract(F.try_url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))), r"([^/]+)$", 1)
    return records(cells.select(name.alias("source_file"), (F.shiftleft("_number", ROWS) + F.col("start") + F.col("place")).alias("seq"), *named))


def read(spark: SparkSession, files: list[tuple[int, str]]) -> DataFrame | None:
    """Records of all files; None if all are empty."""
    try:
        rows = csv_splits.lines(spark, [p for _, p in files])
        maps = csv_splits.split_maps(rows, _multiline(spark))
    except AnalysisException as e:
        raise SourceError(f"cannot read {[p for _, p in files][:3]}: {e.getCondition() or e}") from e
    found = settle(shapes(maps), "shapes")
    odd = found.filter("where is null").select("path").orderBy("path").limit(3).collect()
    if odd:
        raise MalformedCsv(f"{[r.path for r in odd]} have no recognizable columns")
    return _records(rows, maps, found, files_table(spark, files))


def read_listed(spark: SparkSession, folder: str, files: DataFrame) -> tuple[DataFrame | None, DataFrame]:
    """(records, (path, reason) of files without known columns) of the CSV files
    below a folder, whose ``listing`` is ``files``; no path passes the driver."""
    rows = csv_splits.lines(spark, [folder], recursiveFileLookup="true", pathGlobFilter="*.[cC][sS][vV]")
    maps = csv_splits.split_maps(rows, _multiline(spark))
    found = settle(shapes(maps), "shapes")
    odd = found.filter("where is null").select(file_column(F.col("path")).alias("path"), F.lit("no recognizable columns").alias("reason"))
    return _records(rows, maps, found.filter("where is not null"), files.select(F.col("path").alias("_path"), F.col("number").alias("_number"))), odd


register("csv", read)
