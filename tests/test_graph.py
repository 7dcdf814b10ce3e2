"""Graph metrics against plain versions on small graphs."""

from __future__ import annotations

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from citemill.operators import graph, splits, traverse

LINE = [(f"n{i:02}", f"n{i + 1:02}") for i in range(20)]
STAR = [("hub", f"leaf{i}") for i in range(5)]
CYCLE = [("p1", "p2"), ("p2", "p3"), ("p3", "p1")]
ODD = [("é", "a:b/c"), ("a:b/c", "007"), ("007", ""), ("x", "x")]
RANDOM = [(str(a), str(b)) for a, b in random.Random(3).sample([(a, b) for a in range(25) for b in range(25) if a != b], 60)]
GRAPHS = {"line": LINE, "star": STAR, "cycle": CYCLE, "odd": ODD, "random": RANDOM}


def frames(rows, edges, extra=()):
    ids = sorted({x for e in edges for x in e} | set(extra))
    return rows("id string", *[(i,) for i in ids]), rows("src string, dst string", *edges), ids


@pytest.mark.parametrize("name", GRAPHS)
def test_pagerank(name, rows):
    vertices, edges, ids = frames(rows, GRAPHS[name], ["alone"])
    out = {i: [d for s, d in GRAPHS[name] if s == i] for i in ids}
    rank = dict.fromkeys(ids, 1 / len(ids))
    for _ in range(100):
        loose = sum(rank[i] for i in ids if not out[i])
        new = {i: 0.15 / len(ids) + 0.85 * loose / len(ids) for i in ids}
        for i in ids:
            for d in out[i]:
                new[d] += 0.85 * rank[i] / len(out[i])
        done = sum(abs(new[i] - rank[i]) for i in ids) < len(ids) * 1e-6
        rank = new
        if done:
            break
    found = {r.id: r.pagerank for r in graph.pagerank(vertices, edges).collect()}
    assert found == pytest.approx(rank, abs=1e-9)
    assert sum(found.values()) == pytest.approx(1)


def paths(out, source):
    distance, number = {source: 0}, {source: 1}
    waiting = deque([source])
    while waiting:
        v = waiting.popleft()
        for w in out[v]:
            if w not in distance:
                distance[w], number[w] = distance[v] + 1, 0
                waiting.append(w)
            if distance[w] == distance[v] + 1:
                number[w] += number[v]
    return distance, number


@pytest.mark.parametrize("name", ["star", "cycle", "random", "odd"])
def test_betweenness(name, rows):
    vertices, edges, ids = frames(rows, GRAPHS[name])
    out = {i: {d for s, d in GRAPHS[name] if s == i and d != i} for i in ids}
    every = {i: paths(out, i) for i in ids}
    wanted = dict.fromkeys(ids, 0.0)
    for s in ids:
        for t in every[s][0]:
            for v in every[s][0]:
                if len({s, t, v}) == 3 and t in every[v][0] and every[s][0][v] + every[v][0][t] == every[s][0][t]:
                    wanted[v] += every[s][1][v] * every[v][1][t] / every[s][1][t]
    n = len(ids)
    found = {r.id: r.betweenness for r in graph.betweenness(vertices, edges).collect()}
    assert found == pytest.approx({i: x / ((n - 1) * (n - 2)) for i, x in wanted.items()})


@pytest.mark.parametrize("name", GRAPHS)
def test_components(name, rows):
    vertices, edges, ids = frames(rows, GRAPHS[name], ["alone"])
    root = {i: i for i in ids}
    for _ in ids:
        for s, d in GRAPHS[name]:
            root[s] = root[d] = min(root[s], root[d])
    assert {r.id: r.component for r in graph.components(vertices, edges).collect()} == root


def test_empty_and_single(rows):
    none, no_edges = rows("id string"), rows("src string, dst string")
    assert graph.density(none, no_edges).first() == (0, 0, 0.0)
    assert graph.pagerank(none, no_edges).count() == 0
    one = rows("id string", ("a",))
    assert graph.pagerank(one, no_edges).first().pagerank == pytest.approx(1)
    assert graph.components(one, no_edges).first() == ("a", "a")
    assert graph.degrees(one, rows("src string, dst string", ("a", "a"))).first() == ("a", 1, 1, 2)


def test_chains_stop_at_cycles_gaps_and_foundational_papers(rows):
    pointers = rows("paper_id string, predecessor_id string, is_foundational boolean", ("a", "b", False), ("b", "a", False), ("c", "d", None), ("d", "e", True), ("e", "f", False), ("g", "h", False))
    found = traverse.positions(traverse.chains(pointers, pointers.select("paper_id")))
    by_start = {}
    for r in sorted(found.collect(), key=lambda r: r.position):
        by_start.setdefault(r.start_id, []).append(r.paper_id)
    assert by_start == {"a": ["b", "a"], "b": ["a", "b"], "c": ["d", "c"], "d": ["d"], "e": ["f", "e"], "g": ["h", "g"]}
    assert traverse.cached_chain(pointers, "c", 5)[1] and not traverse.cached_chain(pointers, "g", 5)[1]


CHAIN = ("paper_id string, title string, year int, citation_count bigint", ("p1", "one", 2017, 50000), ("p2", "two", 2018, 30000), ("p3", "three", 2016, 10000), ("p4", "four", 2013, 2000), ("p5", "five", 2018, 50))
EDGE = "pos int, from_id string, to_id string, is_influential boolean, intents array<string>"


def test_crawl_takes_least_depth(rows):
    papers = rows(*CHAIN)
    refs = rows(EDGE, (1, "p1", "p2", True, []), (2, "p2", "p3", False, ["methodology"]), (3, "p1", "p3", False, ["background"]), (4, "p3", "p4", False, ["other"]))
    cits = rows(EDGE, (1, "p5", "p1", False, ["methodology"]))
    found = {(r.paper_id, r.depth, r.via) for r in traverse.crawl(papers, refs, cits, "p1", 3, "both").collect()}
    assert found == {("p1", 0, "seed"), ("p2", 1, "backward"), ("p3", 1, "backward"), ("p5", 1, "forward")}


def test_tree_has_no_repeats_on_a_path(rows):
    papers = rows(*CHAIN)
    refs = rows(EDGE, (1, "p1", "p2", True, []), (2, "p2", "p1", True, []), (3, "p2", "p3", False, ["methodology"]))
    cits = rows(EDGE, (1, "p5", "p1", False, ["methodology"]))
    nodes = traverse.tree(papers, refs, cits, "p1")
    assert {(r.node_type, r.depth, r.parent_id, r.paper_id) for r in nodes.collect()} == {("target", 0, None, "p1"), ("ancestor", 1, "p1", "p2"), ("ancestor", 2, "p2", "p3"), ("descendant", 1, "p1", "p5")}
    assert {tuple(r) for r in traverse.tree_links(nodes).collect()} == {("p2", "p1"), ("p3", "p2"), ("p1", "p5")}
    assert [r.paper_id for r in traverse.path_to_root(nodes, "p3", 4).orderBy("step").collect()] == ["p3", "p2", "p1"]


def test_clusters_and_splits_do_not_leak(rows, spark):
    r = random.Random(1)
    samples = [(i, [str(r.randrange(150)) for _ in range(2)], r.choice("xyz"), r.choice([None, *range(1, 5000)]), 1990 + r.randrange(30)) for i in range(200)] + [(200, [], "x", 7, 2000)]
    table = rows("sample bigint, chain array<string>, field string, citation_count bigint, year int", *samples)
    labelled = splits.clusters(table)
    number = {x.sample: x.cluster for x in labelled.collect()}
    assert len(number) == 201 and min(number.values()) == 0 and max(number.values()) == len(set(number.values())) - 1
    bounds = splits.tier_bounds(table)
    full = table.join(labelled, "sample").withColumn("tier", splits.tier_column(table["citation_count"], bounds))
    assigned = {x.cluster: x.split for x in splits.assign_splits(splits.cluster_profiles(full)).collect()}
    assert set(assigned) == set(number.values())
    seen = {}
    for i, chain, *_ in samples:
        for paper in chain:
            assert seen.setdefault(paper, assigned[number[i]]) == assigned[number[i]]


@pytest.mark.parametrize("n,wanted", [(1, (1, 0, 0)), (2, (1, 0, 1)), (3, (1, 1, 1)), (10, (8, 1, 1)), (25, (20, 2, 3)), (35, (28, 4, 3))])
def test_quotas(n, wanted, rows):
    profiles = rows("cluster bigint, cluster_size bigint, cluster_max_year int, cluster_field string, cluster_tier string", *[(i, 1, 2000 + i, "f", "low") for i in range(n)])
    found = [r.split for r in splits.assign_splits(profiles).collect()]
    assert tuple(found.count(s) for s in ("train", "val", "test")) == wanted


def test_tier_bins_collapse(spark):
    from pyspark.sql import functions as F

    values = spark.range(6).select(F.col("id").cast("double").alias("x"))
    tiers = lambda bounds: [r[0] for r in values.select(splits.tier_column(F.col("x"), bounds)).collect()]
    assert tiers([1.0, 2.0, 3.0, 4.0]) == ["low", "low", "medium", "high", "very_high", "landmark"]
    assert tiers([2.0, 2.0, 2.0, 4.0]) == ["low", "low", "low", "very_high", "very_high", "landmark"]
    assert tiers([]) == ["unknown"] * 6


def test_hub_edges_are_dealt_out(spark):
    """A star of a million leaves among ordinary edges: no partition holds twice its share."""
    star = spark.range(1_000_000).select(F.lit("hub").alias("src"), F.col("id").cast("string").alias("dst"))
    others = spark.range(200_000).select(F.col("id").cast("string").alias("src"), F.lit("hub").alias("dst"))
    edges = graph.written(star.union(others), "test")
    out = graph.written(edges.groupBy("src").agg(F.count("*").alias("out")), "test")
    few, of_hubs = graph.dealt_edges(edges, out, 8)
    sizes = [r["count"] for part in (few, of_hubs) for r in part.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 1_200_000 and of_hubs.count() == 1_000_000
    assert max(r["count"] for r in of_hubs.groupBy(F.spark_partition_id()).count().collect()) < 2 * 1_000_000 / 8


def test_pagerank_of_a_hub(spark, rows):
    ids = ["hub", *(f"v{i}" for i in range(3000))]
    links = [("hub", i) for i in ids[1:]] + [(i, "hub") for i in ids[1:2000]]
    vertices, edges = rows("id string", *[(i,) for i in ids]), rows("src string, dst string", *links)
    rank = dict.fromkeys(ids, 1 / len(ids))
    for _ in range(5):
        loose = sum(rank[i] for i in ids[2000:])
        new = {i: 0.15 / len(ids) + 0.85 * loose / len(ids) + 0.85 * rank["hub"] / 3000 for i in ids[1:]}
        new["hub"] = 0.15 / len(ids) + 0.85 * loose / len(ids) + 0.85 * sum(rank[i] for i in ids[1:2000])
        rank = new
    found = {r.id: r.pagerank for r in graph.pagerank(vertices, edges, rounds=5, fixed=True).collect()}
    assert found == pytest.approx(rank, abs=1e-12)


def test_sampled_betweenness_keeps_its_bound(rows):
    r = random.Random(5)
    pairs = sorted({(f"{a:03}", f"{b:03}") for a, b in ((r.randrange(300), int(r.paretovariate(0.6)) % 300) for _ in range(900)) if a != b})
    vertices, edges, _ = frames(rows, pairs)
    n = vertices.count()
    assert graph.sources_for(n, 0.15, 0.1) < n
    exact = {x.id: x.betweenness for x in graph.betweenness(vertices, edges).collect()}
    found = {x.id: x.betweenness for x in graph.sampled_betweenness(vertices, edges, 0.15, 0.1).collect()}
    assert found.keys() == exact.keys() and found != exact and max(abs(found[i] - exact[i]) for i in exact) <= 0.15


@pytest.mark.parametrize("name", GRAPHS)
def test_reachability_and_strong_components(name, rows):
    vertices, edges, ids = frames(rows, GRAPHS[name], ["alone"])
    reach = {i: {d for s, d in GRAPHS[name] if s == i} for i in ids}
    for k in ids:
        for i in ids:
            if k in reach[i]:
                reach[i] |= reach[k]
    found = [(r.source, r.vertex) for r in graph.reachable(vertices, edges).collect()]
    assert len(found) == len(set(found)) and set(found) == {(i, v) for i in ids for v in reach[i]}
    wanted = {i: min([i, *(v for v in reach[i] if i in reach[v])]) for i in ids}
    assert {r.id: r.component for r in graph.strong_components(vertices, edges).collect()} == wanted
