"""Anomalies as rows (category, anomaly, id, detail)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citemill.functions.metrics import zero


def _rows(rows: DataFrame, category: str, anomaly: str, key: Column, detail: Column | None = None) -> DataFrame:
    return rows.select(F.lit(category).alias("category"), F.lit(anomaly).alias("anomaly"), key.alias("id"), (F.lit(None) if detail is None else detail).cast("string").alias("detail"))


def missing_data(papers: DataFrame) -> DataFrame:
    """A paper is listed for each of abstract, year and venue that is null, empty or 0; one scan."""
    bad = {"missing_abstracts": F.coalesce(F.col("abstract"), F.lit("")) == "", "missing_years": zero(F.col("year")) == 0, "missing_venues": F.coalesce(F.col("venue"), F.lit("")) == ""}
    listed = papers.select(F.col("paper_id"), F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in bad.items()]))).alias("anomaly"))
    return listed.select(F.lit("missing_data").alias("category"), "anomaly", F.col("paper_id").alias("id"), F.lit(None).cast("string").alias("detail"))


def outliers(papers: DataFrame, limit: float = 3.0) -> DataFrame:
    """paper_id, z_score, citation_count and title of papers more than limit sample deviations from the mean; none
    among fewer than three papers."""
    count = zero(F.col("citation_count")).cast("double")
    stats = papers.agg(F.avg(count).alias("_mean"), F.stddev_samp(count).alias("_sd"), F.count("*").alias("_n"))
    z = F.try_divide(count - F.col("_mean"), F.col("_sd"))
    found = papers.join(F.broadcast(stats)).filter("_n >= 3 and _sd > 0").withColumn("z_score", z)
    return found.filter(F.abs("z_score") > limit).select("paper_id", "z_score", zero(F.col("citation_count")).alias("citation_count"), F.substring(F.coalesce("title", F.lit("")), 1, 50).alias("title"))


def edge_anomalies(edges: DataFrame) -> DataFrame:
    """Self-citations, and every repeat of an edge after its first row."""
    n = F.row_number().over(Window.partitionBy("from_id", "to_id").orderBy("pos"))
    repeats = edges.withColumn("n", n).filter("n > 1")
    pair = F.concat(F.substring("from_id", 1, 20), F.lit(" -> "), F.substring("to_id", 1, 20))
    return _rows(edges.filter("from_id = to_id"), "citation_anomalies", "self_citations", F.col("from_id")).unionByName(_rows(repeats, "citation_anomalies", "duplicate_citations", F.col("from_id"), pair))


def disconnected(papers: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.select(F.explode(F.array("from_id", "to_id")).alias("paper_id"))
    return papers.join(ends, "paper_id", "left_anti").select("paper_id")


def all_anomalies(papers: DataFrame, edges: DataFrame) -> DataFrame:
    far = _rows(outliers(papers), "outliers", "citation_outliers", F.col("paper_id"), F.round("z_score", 6))
    alone = _rows(disconnected(papers, edges), "disconnected_papers", "disconnected_papers", F.col("paper_id"))
    return missing_data(papers).unionByName(far).unionByName(edge_anomalies(edges)).unionByName(alone)
