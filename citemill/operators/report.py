"""Report aggregates over the stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citemill.operators.quantiles import exact_percentiles


def totals(papers: DataFrame, authors: DataFrame, citations: DataFrame) -> DataFrame:
    """papers, authors (distinct names) and citations, in one job."""
    parts = papers.select(F.lit("p").alias("t"), F.lit(None).cast("string").alias("name")).unionByName(authors.select(F.lit("a").alias("t"), F.col("author_name").alias("name"))).unionByName(citations.select(F.lit("c").alias("t"), F.lit(None).cast("string").alias("name")))
    return parts.agg(F.count_if(F.col("t") == "p").alias("papers"), F.count_distinct("name").alias("authors"), F.count_if(F.col("t") == "c").alias("citations"))


def by_value(rows: DataFrame, column: str) -> DataFrame:
    return rows.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))


def top_values(rows: DataFrame, column: str, k: int = 10) -> DataFrame:
    kept = rows.filter(F.coalesce(F.col(column), F.lit("")) != "")
    return kept.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(k)


def count_stats(papers: DataFrame, column: str = "citation_count") -> DataFrame:
    """Smallest, largest and mean count; the mean as a whole number, halves away from zero."""
    return papers.agg(F.min(column).alias("low"), F.max(column).alias("high"), F.round(F.avg(column)).cast("int").alias("mean"))


def numeric_stats(rows: DataFrame, *columns: str) -> DataFrame:
    """column, count, mean, std (of the population), min, p25, median, p75, max of several columns; moments in one pass, exact
    quantiles by exact_percentiles()."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns])).alias("s")
    moments = rows.select(each).select("s.*").groupBy("column").agg(F.count("x").alias("count"), F.round(F.avg("x"), 2).alias("mean"), F.round(F.stddev_pop("x"), 2).alias("std"), F.min("x").alias("min"), F.max("x").alias("max"))
    found = exact_percentiles(rows, columns, (0.25, 0.5, 0.75))
    quantiles = rows.sparkSession.createDataFrame([(c, *(found[c] or (None,) * 3)) for c in columns], "column string, p25 double, median double, p75 double")
    return moments.join(F.broadcast(quantiles), "column").select("column", "count", "mean", "std", "min", "p25", "median", "p75", "max")


def histograms(rows: DataFrame, *dimensions: str) -> DataFrame:
    """dimension, value and n for several columns, in one scan and shuffle."""
    each = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.coalesce(F.col(d).cast("string"), F.lit("unknown")).alias("value")) for d in dimensions])).alias("h")
    return rows.select(each).select("h.*").groupBy("dimension", "value").agg(F.count("*").alias("n"))


def split_shares(rows: DataFrame, dimension: str, splits: tuple[str, ...] = ("train", "val", "test")) -> DataFrame:
    """For each value, the percentage of each split's rows that have it."""
    totals_ = {s: F.sum(F.col(s)).over(_all()) for s in splits}
    counts = rows.groupBy(F.col(dimension).alias("value")).pivot("split", list(splits)).count().na.fill(0)
    return counts.select("value", *[F.round(F.coalesce(F.try_divide(F.lit(100.0) * F.col(s), totals_[s]), F.lit(0.0)), 2).alias(s) for s in splits])


def _all():
    from pyspark.sql import Window

    return Window.partitionBy()


def text_stats(rows: DataFrame, *columns: str) -> DataFrame:
    """Lengths in characters and estimated tokens (a quarter)."""
    out = []
    for c in columns:
        n = F.length(c)
        out += [F.round(F.avg(n), 2).alias(f"{c}_chars"), F.max(n).cast("bigint").alias(f"{c}_longest"), F.sum(F.floor(n / 4)).cast("bigint").alias(f"{c}_tokens")]
    return rows.agg(F.count("*").alias("rows"), *out)


def status_counts(rows: DataFrame, statuses: tuple[str, ...], also: dict[str, Column] | None = None) -> DataFrame:
    """One row: how many rows have each status; also: further counts by condition."""
    return rows.agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in statuses], *[F.count_if(c).alias(n) for n, c in (also or {}).items()])


def best_by(rows: DataFrame, name: str, *metrics: str) -> DataFrame:
    """The best row's name for each metric; ties go to the smallest name."""
    return rows.agg(*[F.min_by(name, F.struct((-F.col(m)).alias("v"), F.col(name).alias("n"))).alias(m) for m in metrics])


def latest_version(versions: DataFrame) -> DataFrame:
    """The row with the largest whole-number version."""
    return versions.agg(F.max_by(F.struct(*versions.columns), F.expr("try_cast(version as int)")).alias("row")).select("row.*")
