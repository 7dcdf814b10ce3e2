"""Deduplication, referential closure and normalisation of records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citemill.functions.text import clean_authors, clean_text, clean_venue


def first_by(rows: DataFrame, keys: list[str], order: str = "pos") -> DataFrame:
    """The first row of each key by input position."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return rows.withColumn("_n", n).filter("_n = 1").drop("_n")


def last_by(rows: DataFrame, keys: list[str], order: str = "pos") -> DataFrame:
    """The last row of each key by input position, by one aggregation without sorting."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_last")).select(*keys, "_last.*").select(*rows.columns)


def clean_papers(papers: DataFrame) -> DataFrame:
    """Texts cleaned, venue written out, negative counts 0, authors' names cleaned; one row per paper_id."""
    kinds = dict(papers.dtypes)
    changes = {"title": clean_text(F.col("title")), "venue": clean_venue(F.col("venue"))}
    if "abstract" in kinds:
        changes["abstract"] = clean_text(F.col("abstract"))
    if "authors" in kinds:
        changes["authors"] = clean_authors(F.col("authors"))
    for count in ("citation_count", "influential_count", "reference_count"):
        if count in kinds:
            changes[count] = F.greatest(F.col(count), F.lit(0))
    return first_by(papers.withColumns(changes), ["paper_id"])


def drop_self(edges: DataFrame) -> DataFrame:
    return edges.filter(~F.col("from_id").eqNullSafe(F.col("to_id")))


def close(edges: DataFrame, papers: DataFrame) -> DataFrame:
    """Edges with both ends among the papers."""
    ids = papers.select("paper_id")
    for end in ("from_id", "to_id"):
        edges = edges.join(ids, edges[end] == ids["paper_id"], "left_semi")
    return edges


def clean_edges(edges: DataFrame, papers: DataFrame) -> DataFrame:
    return first_by(close(drop_self(edges), papers), ["from_id", "to_id"])


def cleaning_stats(before: dict[str, DataFrame], after: dict[str, DataFrame]) -> DataFrame:
    """kind, rows_before, rows_after and removed of each table, in one job."""
    parts = [rows.select(F.lit(kind).alias("kind"), F.lit(side).alias("side")) for side, tables in (("before", before), ("after", after)) for kind, rows in tables.items()]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    n = lambda side: F.count_if(F.col("side") == side)
    return union.groupBy("kind").agg(n("before").alias("rows_before"), n("after").alias("rows_after"), (n("before") - n("after")).alias("removed"))
