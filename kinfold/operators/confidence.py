"""Confidence of fields and of profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold import constants as K


def top_field(field: Column) -> Column:
    return F.substring_index(field, ".", 1)


def field_confidence(marks: DataFrame, by: list[str], source: str = "source", confidence: str = "confidence") -> DataFrame:
    """(by..., score): the largest confidence plus a bonus for each further
    distinct source, 1 at most."""
    per = marks.groupBy(*by, source).agg(F.max(confidence).alias("_c"))
    bonus = F.lit(K.CORROBORATION) * (F.count(source) - 1)
    return per.groupBy(*by).agg(F.least(F.max("_c") + bonus, F.lit(1.0)).alias("score"))


def active() -> dict[str, Column]:
    """Field -> whether a profile has it; in the order of the weighted sum."""
    text = lambda c: F.coalesce(F.length(c) > 0, F.lit(False))
    some = lambda n: F.size(n) > 0
    return {
        "full_name": text("full_name"), "emails": some("emails"), "phones": some("phones"),
        "location": text("location.city") | text("location.region") | text("location.country"),
        "links": text("links.linkedin") | text("links.github") | text("links.portfolio"),
        "headline": text("headline"), "years_experience": F.col("years_experience").isNotNull(),
        "skills": some("skills"), "experience": some("experience"), "education": some("education"),
    }


def weighted(scores: dict[str, Column], weights: dict[str, float] = K.FIELD_WEIGHTS) -> Column:
    """Weighted mean of the scores that are above 0; 0 if there is none."""
    total, weight = F.lit(0.0), F.lit(0.0)
    for name, s in scores.items():
        w = weights.get(name, K.DEFAULT_WEIGHT)
        counts = F.coalesce(s, F.lit(0.0)) > 0
        total = total + F.when(counts, s * w).otherwise(0.0)
        weight = weight + F.when(counts, F.lit(w)).otherwise(0.0)
    return F.when(weight > 0, total / weight).otherwise(0.0)


def score_columns(marks: DataFrame, by: str = "component") -> DataFrame:
    """(by, _score_<field>...) for the top-level fields, from rows of marks
    (by, field, source, confidence)."""
    scores = field_confidence(marks.withColumn("_field", top_field(F.col("field"))), [by, "_field"])
    return scores.groupBy(by).agg(*[F.max(F.when(F.col("_field") == n, F.col("score"))).alias(f"_score_{n}") for n in active()])


def from_scores(profiles: DataFrame) -> DataFrame:
    """Profiles with overall_confidence, rounded to 4 places, from the columns
    _score_<field>, which go."""
    scores = {n: F.when(on, F.col(f"_score_{n}")) for n, on in active().items()}
    rows = profiles.withColumn("overall_confidence", F.round(weighted(scores), 4))
    return rows.drop(*[f"_score_{n}" for n in scores])


def with_confidence(profiles: DataFrame, marks: DataFrame, by: str = "component") -> DataFrame:
    """Profiles with overall_confidence from their marks as rows: no entity's marks
    ever meet in one row."""
    return from_scores(profiles.join(score_columns(marks, by), by, "left"))
