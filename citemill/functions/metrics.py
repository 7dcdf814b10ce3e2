"""Numbers of papers and of model outputs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def zero(x: Column) -> Column:
    return F.coalesce(x, F.lit(0))


def paper_age(year: Column, current_year: int) -> Column:
    return F.when(year.isNull(), 1).otherwise(F.greatest(F.lit(1), F.lit(current_year) - year))


def recency(age: Column, current_year: int, since: int = 1990) -> Column:
    span = current_year - since
    raw = 1.0 - age / span if span > 0 else F.lit(0.5)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))


def temporal_category(offset: Column) -> Column:
    return F.when(offset < -5, "foundational").when(offset < -1, "recent_predecessor").when(offset <= 1, "contemporary").otherwise("subsequent")


def influence(citations: Column, influential: Column, velocity: Column) -> Column:
    return zero(citations) + zero(influential) * 10 + velocity * 100


def citation_tier(n: Column) -> Column:
    """Fixed cuts of an evaluation corpus."""
    return F.when(n.isNull(), "unknown").when(n < 5_100, "low").when(n < 12_327, "medium").when(n < 31_913, "high").otherwise("viral")


def temporal_gap(year: Column, earlier: Column) -> Column:
    return year - earlier


def composite(soft: Column, judge: Column) -> Column:
    return 0.75 * F.coalesce(soft, F.lit(0.0)) + F.coalesce(judge, F.lit(0.0)) / 5.0 * 0.25


def reciprocal_rank(truth: Column, predicted: Column, others: Column) -> Column:
    """1 for the predicted id, 1/rank for a place (from 2) among the others, else 0; a null truth wants a null prediction."""
    place = F.array_position(others, truth)
    listed = F.when(place > 0, 1.0 / (place + 1)).otherwise(0.0)
    return F.when(truth.isNull(), predicted.isNull().cast("double")).when(predicted.eqNullSafe(truth), 1.0).otherwise(F.coalesce(listed, F.lit(0.0)))


def set_f1(predicted: Column, truth: Column) -> Column:
    """F1 of two arrays as sets: 1 if both are empty, 0 if one is."""
    p, t = F.array_distinct(predicted), F.array_distinct(truth)
    common = F.size(F.array_intersect(p, t))
    both = F.size(p) + F.size(t)
    return F.when(both == 0, 1.0).otherwise(2.0 * common / F.greatest(both, F.lit(1)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector is missing or zero."""
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def mean_of(*scores: Column) -> Column:
    return F.aggregate(F.array(*scores), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0))) / len(scores)
