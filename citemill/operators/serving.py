"""The serving store: lookups, saved fetches, analyses and trees, over tables keyed by paper."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citemill.operators.clean import first_by
from citemill.operators.merge import insert_new, merge, upsert_serving_papers


def lookup(papers: DataFrame, fetch_log: DataFrame, key: str) -> DataFrame:
    """The paper with this id, or else, for ARXIV: keys, with this arXiv id; with whether its references were fetched."""
    bare = key.split(":", 1)[1] if key.upper().startswith("ARXIV:") else None
    match = F.when(F.col("paper_id") == key, 0)
    if bare:
        match = match.when(F.col("arxiv_id") == bare, 1)
    row = papers.withColumn("_match", match).filter("_match is not null").orderBy("_match").limit(1).drop("_match")
    log = fetch_log.filter("fetch_type = 'references'").select("paper_id", F.col("result_count").alias("references_count"))
    return row.join(log, "paper_id", "left").withColumn("references_fetched", F.col("references_count").isNotNull())


def read_through(keys: DataFrame, *tiers: tuple[str, DataFrame]) -> DataFrame:
    """keys (paper_id) with the record of the first tier that has it, and the tier's name; null where none has."""
    out = keys
    for n, (name, rows) in enumerate(tiers):
        rest = [c for c in rows.columns if c != "paper_id"]
        out = out.join(rows.select("paper_id", F.struct(F.lit(name).alias("tier"), *rest).alias(f"_{n}")), "paper_id", "left")
    return out.select("paper_id", F.coalesce(*[F.col(f"_{n}") for n in range(len(tiers))]).alias("found")).select("paper_id", "found.*")


def page(rows: DataFrame, by: list[Column], limit: int, offset: int = 0, cap: int = 9000) -> DataFrame:
    """One page of an ordered listing; nothing at or beyond the cap."""
    return rows.orderBy(*by).limit(min(offset + limit, cap)).offset(offset)


def save_fetch(papers: DataFrame, edges: DataFrame, fetch_log: DataFrame, fetched: DataFrame, requests: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stubs of papers that aren't known, edges that aren't known, and a log row for each request, also an empty one.

    fetched: the edges with other_id, title, year and citation_count of the paper at the far end."""
    stubs = fetched.select(F.col("other_id").alias("paper_id"), "title", "year", "citation_count")
    stubs = stubs.select(*[c for c in papers.columns if c in stubs.columns]).dropDuplicates(["paper_id"])
    known = papers.select("paper_id")
    new_papers = papers.unionByName(stubs.join(known, "paper_id", "left_anti"), allowMissingColumns=True)
    new_edges = insert_new(edges, fetched.select(*edges.columns), keys)
    count = fetched.groupBy(F.col(keys[0]).alias("paper_id")).agg(F.count("*").alias("n"))
    logged = requests.join(count, "paper_id", "left").withColumn("result_count", F.coalesce("n", F.lit(0)).cast("int")).drop("n")
    log_keys = ["paper_id", "fetch_type", "year_start", "year_end"]
    return new_papers, new_edges, merge(fetch_log, logged, log_keys, {c: F.col(f"n.{c}") for c in fetch_log.columns if c not in log_keys})


def assemble_analysis(lineage: DataFrame, analysis: DataFrame, comparison: DataFrame, influences: DataFrame, papers: DataFrame) -> DataFrame:
    """One row per lineage entry: its analysis and comparison, where there are any, and its influences with titles."""
    titles = papers.select(F.col("paper_id").alias("influence_id"), F.col("title").alias("influence_title"), F.col("year").alias("influence_year"))
    named = influences.join(titles, "influence_id", "left")
    listed = named.groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("influence_id", "influence_title", "influence_year", "contribution"))).alias("influences"))
    out = lineage.join(analysis, "paper_id", "left").join(comparison, "paper_id", "left").join(listed, "paper_id", "left")
    return out.withColumn("influences", F.coalesce("influences", F.array().cast(listed.schema["influences"].dataType)))


def split_analysis(bundle: DataFrame) -> dict[str, DataFrame]:
    """Rows for the four tables of a bundle (paper_id, predecessor_id, is_foundational, analysis struct, comparison struct,
    influences array): no comparison for foundational papers."""
    return {
        "lineage": bundle.select("paper_id", "predecessor_id", "is_foundational"),
        "analysis": bundle.filter("analysis is not null").select("paper_id", "analysis.*"),
        "comparison": bundle.filter("comparison is not null and not is_foundational").select("paper_id", "comparison.*"),
        "influences": bundle.select("paper_id", F.explode("influences").alias("i")).select("paper_id", "i.*"),
    }


def save_tree(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """Stored nodes with a tree's nodes; the first node of each tree and paper wins."""
    return insert_new(nodes, first_by(new, ["tree_id", "paper_id"]).select(*nodes.columns), ["tree_id", "paper_id"])


def save_feedback(stored: DataFrame, new: DataFrame) -> DataFrame:
    bad = new.filter(~F.coalesce(F.col("rating").isin(1, -1), F.lit(False)))
    if not bad.isEmpty():
        raise ValueError("a rating is 1 or -1")
    return insert_new(stored, new, ["feedback_id"])


def save_papers(stored: DataFrame, new: DataFrame) -> DataFrame:
    return upsert_serving_papers(stored, new.dropDuplicates(["paper_id"]))


def not_in_store(papers: DataFrame, blobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Papers whose file isn't there, and those whose is."""
    there = blobs.select("name")
    return papers.join(there, papers["file_name"] == there["name"], "left_anti"), papers.join(there, papers["file_name"] == there["name"], "left_semi")


def manifest(files: DataFrame) -> DataFrame:
    """Files with their sizes and a total row."""
    return files.rollup("name").agg(F.sum("length").alias("bytes")).withColumn("name", F.coalesce("name", F.lit("total")))


def canonical_papers(works: DataFrame) -> DataFrame:
    """Works of the alternate catalog in the shape of paper records."""
    last = lambda c: F.element_at(F.split(F.coalesce(c, F.lit("")), "/"), -1)
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    authors = F.transform("authorships", lambda a: F.struct(last(a["author"]["id"]).alias("authorId"), F.coalesce(a["author"]["display_name"], F.lit("")).alias("name")))
    paper_id = last(F.col("id"))
    return works.select(
        paper_id.alias("paper_id"), text("display_name").alias("title"), text("abstract").alias("abstract"), F.col("publication_year").alias("year"),
        F.coalesce("cited_by_count", F.lit(0)).alias("citation_count"), F.lit(0).alias("influential_count"), F.greatest(F.size("referenced_works"), F.lit(0)).alias("reference_count"),
        F.coalesce(authors, F.array().cast("array<struct<authorId:string,name:string>>")).alias("authors"),
        F.struct(F.replace(text("doi"), F.lit("https://doi.org/"), F.lit("")).alias("DOI"), paper_id.alias("OpenAlex")).alias("external_ids"), text("venue").alias("venue"), text("id").alias("url"),
    )
