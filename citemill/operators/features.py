"""Paper features relative to a target paper, and their normalisation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citemill.functions.metrics import influence, paper_age, recency, temporal_category, zero


def with_metrics(papers: DataFrame, metrics: DataFrame) -> DataFrame:
    """Graph metrics (id, pagerank, betweenness, in_degree, out_degree) beside papers; missing ones are 0."""
    names = [c for c in ("pagerank", "betweenness", "in_degree", "out_degree") if c in metrics.columns]
    joined = papers.join(metrics.select(F.col("id").alias("paper_id"), *names), "paper_id", "left")
    return joined.withColumns({n: F.coalesce(n, F.lit(0).cast(dict(metrics.dtypes)[n])) for n in names})


def paper_features(papers: DataFrame, target_year: int | None, current_year: int) -> DataFrame:
    """paper_age, citation_velocity, recency_score, years_from_target, temporal_category and influence_score_raw. A
    missing year gives age 1 and offset 0."""
    year, base = F.col("year"), target_year if target_year is not None else current_year
    age = paper_age(year, current_year)
    velocity = zero(F.col("citation_count")) / age
    offset = F.coalesce(year - F.lit(base), F.lit(0))
    return papers.withColumns(
        {
            "paper_age": age,
            "citation_velocity": F.round(velocity, 2),
            "recency_score": F.round(recency(age, current_year), 3),
            "years_from_target": offset,
            "temporal_category": temporal_category(offset),
            "influence_score_raw": F.round(influence(F.col("citation_count"), F.col("influential_count"), velocity), 2),
        }
    )


def normalize(rows: DataFrame, column: str, into: str) -> DataFrame:
    """Min-max over all rows, 0.5 where all are equal. The bounds come from one aggregation and are broadcast, one row."""
    bounds = rows.agg(F.min(column).alias("_low"), F.max(column).alias("_high"))
    span = F.col("_high") - F.col("_low")
    scaled = F.when(span > 0, (F.col(column) - F.col("_low")) / span).otherwise(0.5)
    return rows.join(F.broadcast(bounds)).withColumn(into, F.round(scaled, 3)).drop("_low", "_high")
