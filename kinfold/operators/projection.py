"""Projection configs: from a JSON description to Columns."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinfold import constants as K
from kinfold.errors import ConfigError, ProjectionError
from kinfold.functions.contact import normalize_phone
from kinfold.functions.skills import canonicalize_skill

TYPES = ("string", "string[]", "number", "object", "object[]")
NORMALIZERS = {"E164": normalize_phone, "canonical": canonicalize_skill}
ON_MISSING = ("null", "omit", "error")


@dataclass(frozen=True)
class Field:
    path: str
    source: str
    type: str | None = None
    normalize: str | None = None
    required: bool = False


@dataclass(frozen=True)
class Config:
    fields: tuple[Field, ...]
    include_confidence: bool = True
    include_provenance: bool = True
    on_missing: str = "null"
    strict_paths: bool = field(default=False)


def parse_config(data: dict) -> Config:
    """Check a config's structure, names and paths."""
    if not isinstance(data, dict) or not isinstance(data.get("fields"), list) or not data["fields"]:
        raise ConfigError("a config needs a list of at least one field")
    fields: list[Field] = []
    for raw in data["fields"]:
        if not isinstance(raw, dict) or not isinstance(raw.get("path"), str):
            raise ConfigError(f"not a field: {raw!r}")
        f = Field(raw["path"], raw.get("from") or raw["path"], raw.get("type"), raw.get("normalize"), bool(raw.get("required", False)))
        if f.path in {g.path for g in fields}:
            raise ConfigError(f"output path {f.path!r} is given twice")
        if not re.fullmatch(K.OUTPUT_PATH, f.path):
            raise ConfigError(f"output path {f.path!r} must be letters, digits and underscores")
        if f.type is not None and f.type not in TYPES:
            raise ConfigError(f"unknown type {f.type!r} of {f.path!r}")
        if f.normalize is not None and f.normalize not in NORMALIZERS:
            raise ConfigError(f"unknown normalization {f.normalize!r} of {f.path!r}")
        if not re.match(K.PATH, f.source):
            raise ConfigError(f"invalid source path {f.source!r} of {f.path!r}")
        fields.append(f)
    policy = data.get("on_missing", "null")
    if policy not in ON_MISSING:
        raise ConfigError(f"unknown on_missing {policy!r}")
    for flag in ("include_confidence", "include_provenance"):
        if not isinstance(data.get(flag, True), bool):
            raise ConfigError(f"{flag} must be true or false")
    return Config(
        tuple(fields), data.get("include_confidence", True), data.get("include_provenance", True), policy, bool(data.get("strict_paths", False))
    )


def valid_path(path: Column) -> Column:
    """Whether a source path follows the grammar of configs."""
    return path.rlike(K.PATH)


def config_errors(text: Column) -> Column:
    """What is wrong with configs, given as JSON texts in a column; null if nothing is."""

    @F.pandas_udf("string")
    def check(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> str | None:
            try:
                parse_config(json.loads(t or ""))
            except json.JSONDecodeError:
                return "no JSON"
            except ConfigError as e:
                return str(e)
            return None

        return texts.map(one)

    return check(text)


def load_config(spark: SparkSession, path: str) -> Config:
    """Config from a JSON file that Spark can read."""
    try:
        rows = spark.read.text(path, wholetext=True).collect()
        return parse_config(json.loads("".join(r.value for r in rows)))
    except json.JSONDecodeError as e:
        raise ConfigError(f"{path} is no JSON: {e}") from e
    except ConfigError:
        raise
    except Exception as e:
        raise ConfigError(f"cannot read {path}: {e}") from e


def _step(schema: T.DataType, names: list[str]) -> T.DataType | None:
    """Type at the end of a dotted path; None if a step does not exist."""
    for n in names:
        if isinstance(schema, T.ArrayType):
            schema = schema.elementType
        if not isinstance(schema, T.StructType) or n not in schema.names:
            return None
        schema = schema[n].dataType
    return schema


def resolve(schema: T.StructType, path: str, strict: bool = False) -> tuple[Column, T.DataType]:
    """Column and type of a source path; an unknown path is null.

    ``a.b``, ``a[0]`` and ``a[].b.c``; empty strings and lists are missing, but
    an element that an index picks is taken as it is."""
    head, index, rest = re.match(r"^([\w.]+?)(?:\[(\d*)\](?:\.([\w.]+))?)?$", path).groups()
    names = head.split(".")
    kind = _step(schema, names)
    tail = _step(kind.elementType, rest.split(".")) if rest and isinstance(kind, T.ArrayType) else None
    if kind is None or (index is not None and not isinstance(kind, T.ArrayType)) or (rest and tail is None):
        if strict:
            raise ConfigError(f"no such path: {path}")
        return F.lit(None).cast("string"), T.StringType()
    col = F.col(".".join(f"`{n}`" for n in names))
    if isinstance(kind, T.ArrayType):
        col = F.when(F.size(col) > 0, col)
    if index:
        return F.get(col, F.lit(int(index))), kind.elementType
    if rest:
        def walk(x: Column) -> Column:
            for n in rest.split("."):
                x = x[n]
            return F.nullif(x, F.lit("")) if isinstance(tail, T.StringType) else x

        return F.transform(col, walk), T.ArrayType(tail)
    return (F.nullif(col, F.lit("")) if isinstance(kind, T.StringType) else col), kind


def normalized(col: Column, kind: T.DataType, how: str | None) -> Column:
    """Strings and lists of strings normalised, or kept where that fails."""
    if how is None:
        return col
    f = NORMALIZERS[how]
    if isinstance(kind, T.StringType):
        return F.coalesce(f(col), col)
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
        return F.transform(col, lambda x: F.coalesce(f(x), x))
    return col


def asks_provenance(config: Config) -> bool:
    """Whether any output column reads the provenance of a profile."""
    return config.include_provenance or any(re.split(r"[.\[]", f.source)[0] == "provenance" for f in config.fields)


def columns(schema: T.StructType, config: Config) -> dict[str, tuple[Column, T.DataType]]:
    """Output column -> expression and type; switches come last and win."""
    out = {}
    for f in config.fields:
        col, kind = resolve(schema, f.source, config.strict_paths)
        out[f.path] = (normalized(col, kind, f.normalize), kind)
    for on, name in ((config.include_confidence, "overall_confidence"), (config.include_provenance, "provenance")):
        if on:
            out.pop(name, None)
            out[name] = (F.col(name), schema[name].dataType)
    return out


def project(profiles: DataFrame, config: Config, check: bool = True) -> DataFrame:
    """Profiles in the shape of the config; missing values are null.

    With ``on_missing`` "error" and ``check``, required fields are looked at by
    an action first, and the first that is missing raises a ProjectionError."""
    cols = columns(profiles.schema, config)
    out = profiles.select(*[c.alias(n) for n, (c, _) in cols.items()])
    needed = [f.path for f in config.fields if f.required]
    if check and config.on_missing == "error" and needed:
        row = out.agg(*[F.count(F.when(F.col(n).isNull(), 1)).alias(n) for n in needed]).first()
        for n in needed:
            if row[n]:
                raise ProjectionError(f"required field {n!r} is missing in {row[n]} profiles")
    return out


def to_json(projected: DataFrame, config: Config, into: str = "json") -> DataFrame:
    """One JSON object a row; with ``on_missing`` "omit", optional fields that
    are missing are left out, others show as null."""
    keep_null = {f.path: config.on_missing != "omit" or f.required for f in config.fields}
    parts = []
    for n in projected.columns:
        whole = F.to_json(F.struct(F.col(n)), {"ignoreNullFields": "false"})
        part = F.substring(whole, F.lit(2), F.length(whole) - 2)
        parts.append(part if keep_null.get(n, True) else F.when(F.col(n).isNotNull(), part))
    return projected.select(F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")).alias(into))
