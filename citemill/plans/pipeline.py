"""The citation pipeline: validate, clean, graph, features, tables, quality, anomalies, report.

Everything is lazy but the two gates and the iterative graph metrics. Cleaned tables are written once, as later stages
read them several times.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citemill.operators import anomaly, clean, features, graph, quality, report, tables, validate
from citemill.sources.storage import written


@dataclass
class Network:
    """papers and edges, as they come or cleaned."""

    papers: DataFrame
    refs: DataFrame
    cits: DataFrame


@dataclass
class Result:
    features: DataFrame
    citations: DataFrame
    quality: DataFrame
    anomalies: DataFrame
    totals: DataFrame


def validated(network: Network) -> Network:
    validate.check_error_rate(validate.validation_report(network.papers, network.refs, network.cits))
    return Network(
        validate.split_valid(network.papers, validate.paper_error(network.papers)).valid,
        validate.split_valid(network.refs, validate.edge_error(network.refs, True)).valid,
        validate.split_valid(network.cits, validate.edge_error(network.cits, False)).valid,
    )


def cleaned(network: Network, reused: bool = True) -> Network:
    """Clean records. reused: several steps read the edges, so they are written."""
    papers = written(clean.clean_papers(network.papers), "papers")
    refs, cits = clean.clean_edges(network.refs, papers), clean.clean_edges(network.cits, papers)
    return Network(papers, written(refs, "refs"), written(cits, "cits")) if reused else Network(papers, refs, cits)


def enriched(network: Network, target_year: int | None, current_year: int, with_pagerank: bool = True) -> DataFrame:
    """Papers with degrees, PageRank, features and normalised influence."""
    vertices = network.papers.select(F.col("paper_id").alias("id"))
    edges = written(tables.graph_edges(network.refs, network.cits, network.papers).select(F.col("from_id").alias("src"), F.col("to_id").alias("dst")), "edges")
    metrics = graph.degrees(vertices, edges)
    if with_pagerank:
        metrics = metrics.join(graph.pagerank(vertices, edges), "id")
    rows = features.paper_features(features.with_metrics(network.papers, metrics), target_year, current_year)
    return features.normalize(rows, "influence_score_raw", "influence_score_normalized")


def run(network: Network, authors: DataFrame, target_year: int | None, current_year: int) -> Result:
    known = cleaned(validated(network))
    citations = tables.citations_table(known.refs, known.cits)
    score = quality.quality_report(quality.all_checks(known.papers, authors, citations))
    quality.check_quality(score)
    return Result(enriched(known, target_year, current_year), citations, score, anomaly.all_anomalies(known.papers, citations), report.totals(known.papers, authors, citations))
