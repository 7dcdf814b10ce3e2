"""Walks over citation edges, one join per level; the frontier is written between levels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citemill.functions.metrics import zero
from citemill.operators.clean import first_by
from citemill.operators.ranking import candidates, forward_window, most_cited, top_citations, top_references
from citemill.sources.storage import discard, let_shuffles_go, numbered, written


def crawl(papers: DataFrame, refs: DataFrame, cits: DataFrame, seed: str, max_depth: int = 3, direction: str = "both") -> DataFrame:
    """paper_id and depth of the papers reached from a seed. Level by level: at each depth the best few references
    (backward) of the papers found there are followed, or the best few citations (forward). With both, only the seed is
    also followed forward, to the same depth.

    depth is the least number of steps; a paper is expanded once.
    """
    counts = papers.select(F.col("paper_id").alias("_id"), "title", "year", "citation_count")
    found = written(papers.filter(F.col("paper_id") == seed).select("paper_id", F.lit(0).alias("depth"), F.lit("seed").alias("via")), "crawl")
    frontiers = {d: found for d in ("backward", "forward") if direction in (d, "both")}
    for depth in range(max_depth):
        reached = []
        for way, frontier in frontiers.items():
            ids = frontier.select("paper_id")
            if way == "backward":
                rows = refs.join(F.broadcast(ids), F.col("from_id") == F.col("paper_id"), "left_semi").join(counts, F.col("to_id") == F.col("_id"))
                next_ids = top_references(rows, depth).select(F.col("to_id").alias("paper_id"))
            else:
                years = papers.select(F.col("paper_id").alias("to_id"), F.col("year").alias("to_year"))
                rows = cits.join(F.broadcast(ids), F.col("to_id") == F.col("paper_id"), "left_semi").join(counts, F.col("from_id") == F.col("_id")).join(years, "to_id")
                next_ids = top_citations(rows.filter(forward_window(F.col("to_year"), F.col("year"))), depth).select(F.col("from_id").alias("paper_id"))
            reached.append(next_ids.distinct().withColumn("via", F.lit(way)))
        if not reached:
            break
        union = reached[0] if len(reached) == 1 else reached[0].unionByName(reached[1])
        fresh = union.groupBy("paper_id").agg(F.min("via").alias("via")).join(found.select("paper_id"), "paper_id", "left_anti")
        level = written(fresh.select("paper_id", F.lit(depth + 1).alias("depth"), "via"), "crawl")
        found = found.unionByName(level)
        frontiers = {way: level.filter(F.col("via") == way) for way in frontiers}
        if level.isEmpty():
            break
    return found


def lineage(refs: DataFrame, papers: DataFrame, seed: str, max_depth: int = 3) -> DataFrame:
    """Distinct (paper columns, depth) reached over backward edges: the seed at depth 0, and a paper at each depth at which
    a path of that length reaches it."""
    edges = refs.filter("direction = 'backward'").select("from_id", "to_id").distinct()
    level = papers.filter(F.col("paper_id") == seed).select("paper_id", F.lit(0).alias("depth"))
    found = level = written(level, "lineage")
    for depth in range(1, max_depth + 1):
        step = edges.join(level, edges["from_id"] == level["paper_id"]).select(F.col("to_id").alias("paper_id"), F.lit(depth).alias("depth")).distinct()
        level = written(step, "lineage")
        found = found.unionByName(level)
    return found.join(papers.select("paper_id", "title", "year", "citation_count"), "paper_id").distinct()


def reachability(edges: DataFrame, max_depth: int, direction: str) -> DataFrame:
    """ancestor, descendant and least depth of all pairs within max_depth steps along from_id -> to_id."""
    step = edges.select("from_id", "to_id").distinct()
    found = level = written(step.select(F.col("from_id").alias("ancestor"), F.col("to_id").alias("descendant"), F.lit(1).alias("depth")), "reach")
    for depth in range(2, max_depth + 1):
        further = level.join(step, F.col("descendant") == F.col("from_id")).select("ancestor", F.col("to_id").alias("descendant")).distinct()
        level = written(further.join(found, ["ancestor", "descendant"], "left_anti").withColumn("depth", F.lit(depth)), "reach")
        found = found.unionByName(level)
        if level.isEmpty():
            break
    return found.withColumn("direction", F.lit(direction))


#: Descendants that a block of ancestors may gather before repeated ones are dropped; 4 bytes each.
BLOCK_DESCENDANTS = 100_000_000


def reach_counts(edges: DataFrame, max_depth: int, direction: str, block: int = BLOCK_DESCENDANTS) -> DataFrame:
    """ancestor, depth, direction and the number of descendants whose least depth it is, within max_depth steps along from_id -> to_id:
    reachability() counted, without its pairs.

    What is at a depth from a paper is what is one less from its children, but for what is nearer. So each depth takes one join of
    the edges with arrays of paper numbers, in blocks of ancestors; what a block shuffles goes before the next, and of the last depth
    only counts are kept.
    """
    spark = edges.sparkSession
    step = written(edges.select("from_id", "to_id").distinct(), "reach-steps")
    ids = written(numbered(step.select(F.col("from_id").alias("id")).union(step.select("to_id")).distinct(), "id").select("id", F.col("number").cast("int")), "reach-ids")
    end = lambda of, n: ids.select(F.col("id").alias(of), F.col("number").alias(n))
    links = written(step.join(end("from_id", "a"), "from_id").join(end("to_id", "c"), "to_id").select("a", "c"), "reach-links")
    at = written(links.groupBy("a").agg(F.collect_list("c").alias("at")).select("a", F.col("at").alias("near"), "at"), "reach")
    counts = at.select("a", F.lit(1).alias("depth"), F.size("at").cast("bigint").alias("descendants"))
    counts = [written(counts, "reach-counts")]
    for depth in range(2, max_depth + 1):
        size = at.select(F.col("a").alias("c"), F.size("at").alias("n"))
        blocks = -(-(links.join(size, "c").agg(F.sum("n")).first()[0] or 0) // block)
        parts = []
        for n in range(blocks):
            mine = lambda of: F.pmod(F.xxhash64(of), F.lit(blocks)) == n  # noqa: E731, B023
            sent = links.filter(mine("a")).join(at.select(F.col("a").alias("c"), "at"), "c")
            met = sent.groupBy("a").agg(F.flatten(F.collect_list("at")).alias("met"))
            fresh = met.join(at.filter(mine("a")).select("a", "near"), "a").select("a", "near", F.array_except("met", "near").alias("at"))
            if depth < max_depth:
                parts.append(written(fresh.select("a", F.concat("near", "at").alias("near"), "at"), "reach"))
                found = parts[-1].select("a", F.size("at").alias("n"))
            else:
                found = fresh.select("a", F.size("at").alias("n"))
            counts.append(written(found.filter("n > 0").select("a", F.lit(depth).alias("depth"), F.col("n").cast("bigint").alias("descendants")), "reach-counts"))
            del sent, met, fresh, found
            let_shuffles_go(spark)
        if not parts:
            break
        older, at = at, reduce(DataFrame.unionByName, parts)
        discard(older)
    total = reduce(DataFrame.unionByName, counts)
    return total.join(end("ancestor", "a"), "a").select("ancestor", "depth", F.lit(direction).alias("direction"), "descendants")


FAN_OUT = 3


def tree(papers: DataFrame, refs: DataFrame, cits: DataFrame, root: str, max_depth: int = 2, max_children: int = 5, window: int = 3) -> DataFrame:
    """Flat nodes (node_type, depth, parent_id, paper_id, rank): the target, its ancestors over references, and its
    descendants over citations of the next years.

    Ancestors: FAN_OUT children of each, methodology before influential. Descendants: max_children of the root and
    FAN_OUT below. No node repeats one of its own path.
    """
    counts = papers.select(F.col("paper_id").alias("_id"), "citation_count", "year")
    nodes = papers.filter(F.col("paper_id") == root).select(F.lit("target").alias("node_type"), F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent_id"), "paper_id", F.lit(1).alias("rank"))
    start = papers.filter(F.col("paper_id") == root).select("paper_id", F.array("paper_id").alias("path"), "year")
    for kind, edges, by, other in (("ancestor", refs, "from_id", "to_id"), ("descendant", cits, "to_id", "from_id")):
        level = start
        for depth in range(1, max_depth + 1):
            width = max_children if kind == "descendant" and depth == 1 else FAN_OUT
            rows = edges.join(F.broadcast(level.select(F.col("paper_id").alias(by), "path", F.col("year").alias("parent_year"))), by)
            rows = rows.join(counts, F.col(other) == F.col("_id")).filter(~F.array_contains("path", F.col(other)))
            if kind == "descendant":
                rows = rows.filter(forward_window(F.col("parent_year"), F.col("year"), window))
            best = candidates(first_by(rows, [by, other]), by, width)
            level = written(best.select(F.lit(kind).alias("node_type"), F.lit(depth).alias("depth"), F.col(by).alias("parent_id"), F.col(other).alias("paper_id"), "rank", F.concat("path", F.array(other)).alias("path"), F.coalesce("year", "parent_year").alias("year")), "tree")
            nodes = nodes.unionByName(level.select(*nodes.columns))
            # A paper that several parents reach is followed once, from the smallest path.
            level = level.groupBy("paper_id").agg(F.min("path").alias("path"), F.min_by("year", "path").alias("year"))
    return nodes


def tree_links(nodes: DataFrame) -> DataFrame:
    """source and target of the tree's edges in the direction of time."""
    older = F.col("node_type") == "ancestor"
    child, parent = F.col("paper_id"), F.col("parent_id")
    return nodes.filter("parent_id is not null").select(F.when(older, child).otherwise(parent).alias("source"), F.when(older, parent).otherwise(child).alias("target"))


def path_to_root(nodes: DataFrame, node_id: str, max_depth: int = 10) -> DataFrame:
    """step and paper_id from a node up to the root; of several parents the one of least depth, then the smallest, is taken."""
    level = nodes.filter(F.col("paper_id") == node_id).orderBy("depth", "parent_id").limit(1).select("paper_id", "parent_id", F.lit(0).alias("step"))
    found = level
    for step in range(1, max_depth + 1):
        level = nodes.alias("n").join(F.broadcast(level.select(F.col("parent_id").alias("_p"))), F.col("n.paper_id") == F.col("_p")).orderBy("n.depth", "n.parent_id").limit(1).select("n.paper_id", "n.parent_id", F.lit(step).alias("step"))
        found = found.unionByName(level)
    return found.select("step", "paper_id")


def chains(pointers: DataFrame, starts: DataFrame, max_depth: int = 6) -> DataFrame:
    """start_id, hop, paper_id along predecessor pointers (paper_id, predecessor_id, is_foundational), for all starts at
    once; a chain ends at a foundational paper, a missing pointer, a paper it holds already, or max_depth hops."""
    level = starts.select(F.col("paper_id").alias("start_id"), F.lit(0).alias("hop"), "paper_id", F.array("paper_id").alias("path"))
    found = level = written(level, "chain")
    step = pointers.filter("predecessor_id is not null and not coalesce(is_foundational, false)").select(F.col("paper_id").alias("_at"), "predecessor_id")
    for hop in range(1, max_depth + 1):
        moved = level.join(step, F.col("paper_id") == F.col("_at")).filter(~F.array_contains("path", F.col("predecessor_id")))
        level = written(moved.select("start_id", F.lit(hop).alias("hop"), F.col("predecessor_id").alias("paper_id"), F.concat("path", F.array("predecessor_id")).alias("path")), "chain")
        found = found.unionByName(level)
        if level.isEmpty():
            break
    return found.select("start_id", "hop", "paper_id")


def positions(found: DataFrame) -> DataFrame:
    """chains with position, 1 for the oldest paper."""
    return found.withColumn("position", F.row_number().over(Window.partitionBy("start_id").orderBy(F.desc("hop"))))


def cached_chain(pointers: DataFrame, start: str, max_depth: int) -> tuple[DataFrame | None, bool]:
    """The stored chain of a paper, oldest first, and whether it is whole: it must end at a foundational paper or at
    max_depth without a missing pointer; otherwise (None, False). Cycles are cut by max_depth."""
    found = chains(pointers, pointers.sparkSession.createDataFrame([(start,)], "paper_id string"), max_depth)
    ends = found.orderBy(F.desc("hop")).limit(1).join(pointers, "paper_id", "left").select("hop", "is_foundational").first()
    whole = ends is not None and (bool(ends["is_foundational"]) or ends["hop"] == max_depth)
    return (positions(found), True) if whole else (None, False)


def nested_timeline(found: DataFrame, papers: DataFrame) -> DataFrame:
    """start_id and timeline, the array of its papers, oldest first."""
    rows = positions(found).join(papers.select("paper_id", "title", "year"), "paper_id", "left")
    return rows.groupBy("start_id").agg(F.array_sort(F.collect_list(F.struct("position", "paper_id", "title", "year"))).alias("timeline"))


def repair_chains(entries: DataFrame) -> DataFrame:
    """entries (pos, paper_id, predecessor_id, chain) with empty chains repaired, and repaired. A paper that stands in
    some chain takes the last such chain; or else the first chain of an entry whose predecessor it is. Its own id is
    appended, once more where the chain holds it. Others stay empty."""
    full = entries.filter(F.size("chain") > 0)
    members = full.select("pos", "chain", F.explode("chain").alias("paper_id"))
    own = members.groupBy("paper_id").agg(F.max_by("chain", "pos").alias("own_chain"))
    after = full.filter("predecessor_id is not null").groupBy(F.col("predecessor_id").alias("paper_id")).agg(F.min_by("chain", "pos").alias("after_chain"))
    joined = entries.join(own, "paper_id", "left").join(after, "paper_id", "left")
    empty = F.coalesce(F.size("chain"), F.lit(0)) <= 0
    found = F.coalesce("own_chain", "after_chain")
    fixed = F.when(empty & found.isNotNull(), F.array_append(found, F.col("paper_id"))).otherwise(F.col("chain"))
    return joined.withColumn("repaired", empty & found.isNotNull()).withColumn("chain", fixed).select(*entries.columns, "repaired")


def fetched(papers: DataFrame, fetch_log: DataFrame, kind: str, window: tuple[int, int] | None = None) -> DataFrame:
    """papers with has_rows: whether a fetch of this kind, for exactly this year window, was ever logged, empty or not."""
    log = fetch_log.filter(F.col("fetch_type") == kind)
    if window:
        log = log.filter((F.col("year_start") == window[0]) & (F.col("year_end") == window[1]))
    return papers.join(log.select("paper_id").distinct().withColumn("_there", F.lit(True)), "paper_id", "left").withColumn("has_rows", F.coalesce("_there", F.lit(False))).drop("_there")


def resolve_predecessor(rows: DataFrame) -> DataFrame:
    """predecessor: the candidate with the selected id, or else the first; null without candidates."""
    match = F.filter("candidates", lambda c: c["paper_id"] == F.col("selected_id"))
    return rows.withColumn("predecessor", F.coalesce(F.get(match, 0), F.get("candidates", 0)))


def best_children(edges: DataFrame, by: str, other: str, k: int = FAN_OUT) -> DataFrame:
    return most_cited(edges.withColumn("citation_count", zero(F.col("citation_count"))), by, other, k)
