"""Relevance filters and top-k by group. Ties go by input position and then by id, or by id where that is said, so a result doesn't
depend on the order of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citemill.functions.metrics import zero
from citemill.functions.text import off_topic

#: Papers followed at each depth from 0; later depths as the last.
FOLLOWED = (5, 5, 3, 2)


def has(intent: str) -> Column:
    return F.coalesce(F.array_contains("intents", intent), F.lit(False))


def influential() -> Column:
    return F.coalesce(F.col("is_influential"), F.lit(False))


def is_relevant_reference() -> Column:
    return has("methodology") | has("background") | influential()


def is_relevant_citation() -> Column:
    return has("methodology") | influential()


def top(rows: DataFrame, by: list[str], order: list[Column], k: int | Column) -> DataFrame:
    """At most k rows of each group. k may be an expression of the row."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("rank", n).filter(F.col("rank") <= k)


def limit_at(depth: Column) -> Column:
    limit = F.lit(FOLLOWED[-1])
    for d in range(len(FOLLOWED) - 2, -1, -1):
        limit = F.when(depth <= d, FOLLOWED[d]).otherwise(limit)
    return limit


def top_references(refs: DataFrame, depth: Column | int = 0) -> DataFrame:
    """refs with citation_count of the cited paper -> the best few of each from_id, with score and rank."""
    score = zero(F.col("citation_count")) + influential().cast("int") * 10000 + has("methodology").cast("int") * 5000
    depth = F.lit(depth) if isinstance(depth, int) else depth
    return top(refs.filter(is_relevant_reference()).withColumn("score", score), ["from_id"], [F.desc("score"), F.asc("pos"), F.asc("to_id")], limit_at(depth))


def top_citations(cits: DataFrame, depth: Column | int = 0) -> DataFrame:
    """cits with title and citation_count of the citing paper -> the best few of each to_id that are on topic."""
    score = zero(F.col("citation_count")) + influential().cast("int") * 5000 + has("methodology").cast("int") * 2000
    depth = F.lit(depth) if isinstance(depth, int) else depth
    kept = cits.filter(is_relevant_citation() & ~off_topic(F.col("title")))
    return top(kept.withColumn("score", score), ["to_id"], [F.desc("score"), F.asc("pos"), F.asc("from_id")], F.least(F.lit(3), limit_at(depth)))


def candidates(edges: DataFrame, by: str, k: int, or_anything: bool = False) -> DataFrame:
    """Methodology edges; where a group has fewer than k of them, influential ones as well; with or_anything, every edge
    where a group has neither. The k most cited of each group, with tier (1, 2, 3) and rank."""
    order = [F.desc(zero(F.col("citation_count"))), F.asc("pos"), F.asc("to_id" if by == "from_id" else "from_id"), F.asc("tier")]
    tier = F.when(has("methodology"), 1).when(influential(), 2)
    ranked = _best_of_tiers(edges.withColumn("tier", F.coalesce(tier, F.lit(3)) if or_anything else tier).filter("tier is not null"), by, order, k)
    usable = (F.col("tier") == 1) | ((F.col("tier") == 2) & (F.col("_n1") < k)) | ((F.col("tier") == 3) & (F.col("_n1") + F.col("_n2") == 0))
    return top(ranked.filter(usable).drop("_n1", "_n2"), [by], order, k)


def _best_of_tiers(rows: DataFrame, by: str, order: list[Column], k: int) -> DataFrame:
    """The k best rows of each tier of each group, and how many of them (so k at most) are of tier 1 and 2, in _n1 and _n2.
    Rows beyond the k best of a tier go before the shuffle, so a group of any size is 3 k rows for each task."""
    best = top(rows, [by, "tier"], order, k).drop("rank")
    count = lambda n: F.sum((F.col("tier") == n).cast("int")).over(Window.partitionBy(by))
    return best.withColumns({"_n1": count(1), "_n2": count(2)})


def most_cited(edges: DataFrame, by: str, other: str, k: int) -> DataFrame:
    """The k most cited of each group; ties by id."""
    return top(edges, [by], [F.desc(zero(F.col("citation_count"))), F.asc(other)], k)


def cached_candidates(edges: DataFrame, papers: DataFrame, by: str, other: str, k: int, window: int | None = None) -> DataFrame:
    """Edges whose intents, as JSON text, mention methodology, or influential ones where a group has none; joined with
    the other paper; for citations only those of the window years after the group's paper."""
    rows = edges.join(papers.select(F.col("paper_id").alias(other), "title", "year", "citation_count"), other)
    if window is not None:
        rows = rows.join(papers.select(F.col("paper_id").alias(by), F.col("year").alias("from_year")), by)
        rows = rows.filter(F.col("year").between(F.col("from_year") + 1, F.col("from_year") + window))
    mentions = F.coalesce(F.to_json("intents"), F.lit("")).contains("methodology")
    tiered = rows.withColumn("tier", F.when(mentions, 1).when(influential(), 2)).filter("tier is not null")
    ranked = _best_of_tiers(tiered, by, [F.desc(zero(F.col("citation_count"))), F.asc(other)], k)
    return most_cited(ranked.filter((F.col("tier") == 1) | (F.col("_n1") == 0)).drop("tier", "_n1", "_n2"), by, other, k)


def forward_window(year: Column, citing_year: Column, width: int = 3) -> Column:
    """Whether the citing year is one of the width years after; without a year everything is."""
    return year.isNull() | citing_year.between(year + 1, year + width)


def search_titles(papers: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """Case-insensitive search; wildcards in the query keep their meaning."""
    return papers.filter(F.col("title").ilike(f"%{query}%")).orderBy(F.desc_nulls_last("citation_count"), "paper_id").limit(limit)


def domain_quota(seeds: DataFrame, total: int, seed: int = 0) -> DataFrame:
    """max(1, total // domains) seeds of each domain, in an order fixed by a hash."""
    domains = seeds.select("domain").distinct().count()
    return top(seeds, ["domain"], [F.md5(F.concat_ws(":", F.lit(seed), "paper_id").cast("binary")), F.asc("paper_id")], max(1, total // max(1, domains)))
