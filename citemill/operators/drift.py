"""Feedback and log analytics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citemill.functions.text import sentiment, source_type


def feedback_documents(feedback: DataFrame, papers: DataFrame) -> DataFrame:
    """Feedback with its paper's title, or else the id, as label, and its sentiment."""
    titles = papers.select("paper_id", "title")
    joined = feedback.join(titles, "paper_id", "left")
    return joined.withColumn("label", F.coalesce(F.nullif("title", F.lit("")), "paper_id")).withColumn("sentiment", sentiment(F.col("rating"))).drop("title")


def finetuning_documents(papers: DataFrame, lineage_papers: DataFrame, connections: DataFrame) -> DataFrame:
    """Papers with is_positive: null outside lineages, true with a connection, else false; one row per paper."""
    joined = papers.join(lineage_papers.select("paper_id", "lineage_id").dropDuplicates(["paper_id"]), "paper_id", "left")
    linked = connections.select(F.col("from_id").alias("lineage_id")).distinct().withColumn("linked", F.lit(True))
    rows = joined.join(linked, "lineage_id", "left")
    state = F.when(F.col("lineage_id").isNull(), F.lit(None)).otherwise(F.coalesce("linked", F.lit(False)))
    rows = rows.withColumn("is_positive", state).drop("linked", "lineage_id")
    return rows.withColumn("source_type", source_type(F.col("text_availability"))) if "text_availability" in rows.columns else rows


def index_upsert(documents: DataFrame, key: str, order: str) -> DataFrame:
    """The last document of each key."""
    return documents.groupBy(key).agg(F.max_by(F.struct(*[c for c in documents.columns if c != key]), F.col(order)).alias("d")).select(key, "d.*")


def terms(rows: DataFrame, field: str, k: int = 10) -> DataFrame:
    """The k most frequent values; missing ones are left out."""
    return rows.filter(F.col(field).isNotNull()).groupBy(field).agg(F.count("*").alias("n")).orderBy(F.desc("n"), field).limit(k)


def date_histogram(rows: DataFrame, ts: str, interval: str = "1 day", split: str | None = None, k: int = 5) -> DataFrame:
    """Rows by time bucket and, with split, by its k most frequent values; empty buckets are left out."""
    kept = rows.filter(F.col(ts).isNotNull())
    if split:
        kept = kept.join(F.broadcast(terms(kept, split, k).select(split)), split, "left_semi")
    bucket = F.window(F.col(ts).cast("timestamp"), interval)["start"]
    return kept.groupBy(bucket.alias("bucket"), *([split] if split else [])).agg(F.count("*").alias("n"))


def cardinality(rows: DataFrame, field: str, precision: float = 0.01) -> DataFrame:
    return rows.agg(F.approx_count_distinct(field, precision).alias("n"))


def sessions(rows: DataFrame, by: str, ts: str, gap: str = "30 minutes") -> DataFrame:
    """Extension: runs of events of one key without a gap of the given length."""
    return rows.groupBy(by, F.session_window(F.col(ts).cast("timestamp"), gap).alias("s")).agg(F.count("*").alias("n")).select(by, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def day_over_day(rows: DataFrame, ts: str) -> DataFrame:
    """Extension: daily counts and their change against the day before; the window sees a row for each day of the table's time."""
    daily = date_histogram(rows, ts)
    return daily.withColumn("change", F.col("n") - F.lag("n").over(Window.orderBy("bucket")))
