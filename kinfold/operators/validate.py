"""Constraints on projected output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinfold.errors import ProjectionError, ValidationError

from .confidence import active
from .projection import Config


def type_fits(kind: T.DataType, declared: str) -> bool:
    """Whether a column type can hold what the config declares."""
    number = isinstance(kind, T.NumericType)
    match declared:
        case "string":
            return isinstance(kind, T.StringType)
        case "number":
            return number
        case "object":
            return isinstance(kind, T.StructType)
        case "string[]":
            return isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType)
        case "object[]":
            return isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType)
    return False


def rules(rows: DataFrame, config: Config) -> dict[str, Column]:
    """Rule -> whether a row breaks it."""
    out = {}
    for f in config.fields:
        c, kind = F.col(f.path), rows.schema[f.path].dataType
        if f.required:
            out[f"{f.path}: required"] = c.isNull()
        if f.type is not None and not type_fits(kind, f.type):
            out[f"{f.path}: not {f.type}"] = c.isNotNull()
        elif f.type in ("string[]", "object[]"):
            out[f"{f.path}: null element"] = F.coalesce(F.exists(c, lambda x: x.isNull()), F.lit(False))
    if config.include_confidence and "overall_confidence" in rows.columns:  # rows that no projection made may have none
        c = F.col("overall_confidence")
        out["overall_confidence: not between 0 and 1"] = F.coalesce(~c.between(0.0, 1.0), F.lit(False))
    return out


def violations(rows: DataFrame, config: Config) -> DataFrame:
    """(rows' columns, violation): a row for each broken rule of each row."""
    named = [F.when(broken, F.lit(rule)) for rule, broken in rules(rows, config).items()]
    if not named:
        return rows.withColumn("violation", F.lit(None).cast("string")).limit(0)
    found = F.filter(F.array(*named), lambda x: x.isNotNull())
    return rows.withColumn("violation", F.explode(found))


class Watch:
    """Counts of broken rules, observed while the rows are written."""

    def __init__(self, names: list[str], config: Config):
        self.names, self.config, self.observation = names, config, Observation()

    def counts(self) -> dict[str, int]:
        """Rule -> rows that break it; waits for the action that writes the rows."""
        if not self.names:
            return {}
        seen = self.observation.get
        return {rule: seen.get(f"r{i}") or 0 for i, rule in enumerate(self.names)}

    def check(self) -> None:
        """Raise what is broken: a required field that ``on_missing`` makes an
        error, else all rules with their counts."""
        counts = self.counts()
        for f in self.config.fields:
            n = counts.get(f"{f.path}: required", 0)
            if n and self.config.on_missing == "error":
                raise ProjectionError(f"required field {f.path!r} is missing in {n} profiles")
        broken = [f"{rule} ({n} rows)" for rule, n in sorted(counts.items()) if n]
        if broken:
            raise ValidationError("; ".join(broken))


def watched(rows: DataFrame, config: Config) -> tuple[DataFrame, Watch]:
    """``rows`` whose broken rules are counted by the first action on them, and
    the counts: the rows are read once, for the checks and for the sink."""
    found = rules(rows, config)
    watch = Watch(list(found), config)
    if not found:
        return rows, watch
    return rows.observe(watch.observation, *[F.count_if(broken).alias(f"r{i}") for i, broken in enumerate(found.values())]), watch


def confidence_violations(rows: DataFrame, column: str) -> DataFrame:
    """Rows whose confidence is not between 0 and 1."""
    return rows.filter(~F.col(column).between(0.0, 1.0))


def without_provenance(profiles: DataFrame) -> DataFrame:
    """(candidate_id, field) of fields that have a value but no provenance."""
    names = F.transform("provenance", lambda p: F.substring_index(p["field"], ".", 1))
    missing = [F.when(on & ~F.array_contains(names, n), F.lit(n)) for n, on in active().items()]
    return profiles.select("candidate_id", F.explode(F.filter(F.array(*missing), lambda x: x.isNotNull())).alias("field"))


def validate(rows: DataFrame, config: Config) -> DataFrame:
    """``rows``, or a ValidationError that names the rules broken, with how many
    rows break them.  This reads the rows; ``watched`` checks while they are written."""
    seen, watch = watched(rows, config)
    if watch.names:
        seen.write.format("noop").mode("overwrite").save()
        watch.check()
    return rows
