"""Relational tables from records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citemill.functions.ids import author_id
from citemill.functions.metrics import zero
from citemill.operators.clean import first_by


def papers_table(papers: DataFrame, now: Column) -> DataFrame:
    """The stored columns. text_availability is full_text wherever there is an abstract."""
    text = lambda c: F.coalesce(F.col(c), F.lit("")) if c in papers.columns else F.lit("")
    arxiv = F.coalesce(F.col("external_ids")["ArXiv"], F.lit("")) if "external_ids" in papers.columns else F.lit("")
    full = (text("abstract") != "") if "abstract" in papers.columns else F.lit(False)
    return papers.select(
        "paper_id", arxiv.alias("arxiv_id"), text("title").alias("title"), text("abstract").alias("abstract"), "year",
        *[zero(F.col(c)).alias(c) for c in ("citation_count", "influential_count", "reference_count")],
        text("venue").alias("venue"), text("url").alias("urls"), now.alias("first_queried_at"), F.lit(1).alias("query_count"),
        F.when(full, "full_text").otherwise("abstract_only").alias("text_availability"),
    )


def authors_table(papers: DataFrame) -> DataFrame:
    """One row per paper and author; an author without id gets one made of paper, position and name."""
    rows = papers.select("paper_id", F.posexplode("authors").alias("position", "author"))
    name = F.coalesce(F.col("author.name"), F.lit(""))
    return rows.select("paper_id", author_id(F.col("author.authorId"), F.col("paper_id"), F.col("position"), name).alias("author_id"), name.alias("author_name"))


def citations_table(refs: DataFrame, cits: DataFrame) -> DataFrame:
    """All references, and the first of each citation edge that no reference has."""
    pair = ["from_id", "to_id"]
    return refs.unionByName(first_by(cits.join(refs.select(*pair), pair, "left_anti"), pair))


def graph_edges(refs: DataFrame, cits: DataFrame, papers: DataFrame) -> DataFrame:
    """Directed edges between known papers: a reference's attributes come from its last row, a citation's from its
    first where no reference has the edge. Self-loops stay."""
    from citemill.operators.clean import close, last_by

    pair = ["from_id", "to_id"]
    known = last_by(close(refs, papers), pair)
    return known.unionByName(first_by(close(cits, papers).join(known.select(*pair), pair, "left_anti"), pair))


def union_tagged(*parts: tuple[str, DataFrame]) -> DataFrame:
    """Rows of all parts with data_source; columns that a part lacks are null."""
    tagged = [rows.withColumn("data_source", F.lit(tag)) for tag, rows in parts]
    union = tagged[0]
    for part in tagged[1:]:
        union = union.unionByName(part, allowMissingColumns=True)
    return union
