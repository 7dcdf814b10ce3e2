"""The serving store, training examples and the paged source on small rows."""

from __future__ import annotations

import datetime
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from citemill.functions import ids, text
from citemill.operators import drift, evaluate, merge, report, serving, tables, training, traverse
from citemill.sources import readers
from citemill.sources.paged import PagedSource

LOG = "paper_id string, fetch_type string, year_start int, year_end int, result_count int"


def listing(offset, limit, year_from=0, year_to=9999):
    rows = [{"id": n, "year": 2000 + n % 20} for n in range(250)]
    return [r for r in rows if year_from <= r["year"] <= year_to][offset : offset + limit]


def test_paged_source(spark):
    spark.dataSource.register(PagedSource)
    read = spark.read.format("paged").schema("id int, year int").option("page", "tests.test_serving_training:listing").option("pageRows", "100")
    pages = read.load()
    assert pages.count() == 250 and pages.rdd.getNumPartitions() == 90
    assert read.option("offsetCap", "150").load().count() == 150
    assert read.option("offsetCap", "9000").option("yearFrom", "2019").load().count() == 12


def test_paged_source_takes_filters_on_the_year(spark):
    spark.dataSource.register(PagedSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        read = spark.read.format("paged").schema("id int, year int").option("page", "tests.test_serving_training:listing").option("pageRows", "100").option("offsetCap", "300").option("pushYears", "true")
        found = read.load().filter("year >= 2005 and year < 2010 and id > 20")
        after_scan = [line for line in found._jdf.queryExecution().toString().split("Physical Plan")[1].splitlines() if "Filter" in line]
        assert not any("2005" in line or "2010" in line for line in after_scan) and any("id" in line for line in after_scan)
        assert sorted(r.id for r in found.collect()) == [n for n in range(21, 250) if 2005 <= 2000 + n % 20 < 2010]
        assert read.load().filter("year = 2003 and year <= 2001").count() == 0
        assert read.option("yearFrom", "2004").load().filter("year > 2001").count() == 198
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def stored_length():
    return int(Path("/tmp/citemill-listing-length").read_text())


def test_paged_stream_goes_on_at_its_offset(spark, tmp_path):
    spark.dataSource.register(PagedSource)
    stream = spark.readStream.format("paged").schema("id int, year int").option("page", "tests.test_serving_training:listing").option("size", "tests.test_serving_training:stored_length").option("pageRows", "40").load()
    for length in (90, 90, 250):
        Path("/tmp/citemill-listing-length").write_text(str(length))
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
        assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(length))


def test_best_cosines_by_blocks(rows):
    r = random.Random(2)
    vector = lambda: [r.gauss(0, 1) for _ in range(3)]
    truth = [(r.randrange(4), vector()) for _ in range(40)] + [(9, vector()), (1, [0.0] * 3), (2, None)]
    predicted = [(r.randrange(4), vector()) for _ in range(50)] + [(8, vector()), (1, None)]

    def cos(a, b):
        n = (sum(x * x for x in a or []) * sum(x * x for x in b or [])) ** 0.5
        return sum(x * y for x, y in zip(a, b)) / n if n else 0.0

    wanted = {}
    for k, a in truth:
        wanted.setdefault(k, []).append(max((cos(a, b) for j, b in predicted if j == k), default=0.0))
    schema = "sample int, vector array<double>"
    found = evaluate.list_similarity(rows(schema, *truth), rows(schema, *predicted), block=3)
    assert {x["sample"]: x.similarity for x in found.collect()} == pytest.approx({k: sum(v) / len(v) for k, v in wanted.items()})


def test_lookup_by_either_id(rows):
    papers = rows("paper_id string, arxiv_id string, title string", ("a", "1706.1", "x"), ("b", None, "y"))
    log = rows(LOG, ("a", "references", None, None, 0))
    found = serving.lookup(papers, log, "arxiv:1706.1").first()
    assert (found.paper_id, found.references_fetched, found.references_count) == ("a", True, 0)
    assert not serving.lookup(papers, log, "b").first().references_fetched
    assert serving.lookup(papers, log, "1706.1").count() == 0


def test_fetches_are_logged_even_when_empty(rows):
    papers = rows("paper_id string, title string, year int, citation_count bigint", ("a", "x", 2000, 1))
    edges = rows("from_id string, to_id string, is_influential boolean", ("a", "b", False))
    fetched = rows("from_id string, to_id string, is_influential boolean, other_id string, title string, year int, citation_count bigint", ("a", "b", True, "b", "t", 2001, 5), ("a", "c", True, "c", "t", 2001, 5))
    log = rows(LOG, ("a", "references", None, None, 1))
    requests = rows("paper_id string, fetch_type string, year_start int, year_end int", ("a", "references", None, None), ("z", "references", None, None))
    new_papers, new_edges, new_log = serving.save_fetch(papers, edges, log, fetched, requests, ["from_id", "to_id"])
    assert sorted(r.paper_id for r in new_papers.collect()) == ["a", "b", "c"]
    assert sorted((r.to_id, r.is_influential) for r in new_edges.collect()) == [("b", False), ("c", True)]
    assert sorted((r.paper_id, r.result_count) for r in new_log.collect()) == [("a", 2), ("z", 0)]
    status = traverse.fetched(new_papers, new_log, "references")
    assert sorted((r.paper_id, r.has_rows) for r in status.collect()) == [("a", True), ("b", False), ("c", False)]


def test_analysis_bundles(rows):
    schema = "paper_id string, predecessor_id string, is_foundational boolean, analysis struct<core:string>, comparison struct<why:string>, influences array<struct<influence_id:string,contribution:string>>"
    parts = serving.split_analysis(rows(schema, ("a", "b", False, ("c",), ("w",), [("x", "y")]), ("b", None, True, ("d",), ("w",), None)))
    assert parts["comparison"].count() == 1 and parts["influences"].count() == 1
    papers = rows("paper_id string, title string, year int", ("x", "X", 1999))
    found = {r.paper_id: r for r in serving.assemble_analysis(parts["lineage"], parts["analysis"], parts["comparison"], parts["influences"], papers).collect()}
    assert found["a"].influences[0].influence_title == "X" and found["b"].influences == [] and found["b"].why is None


def test_trees_and_feedback(rows):
    nodes = rows("pos int, tree_id string, paper_id string", (1, "t", "a"), (2, "t", "a"), (3, "t", "b"))
    stored = rows("tree_id string, paper_id string", ("t", "b"))
    assert serving.save_tree(stored, nodes).count() == 2
    good = rows("feedback_id string, rating int", ("f", 1), ("g", -1))
    assert serving.save_feedback(good.limit(1), good).count() == 2
    with pytest.raises(ValueError):
        serving.save_feedback(good, rows("feedback_id string, rating int", ("h", 5)))


def test_alternate_catalog(rows):
    schema = "id string, doi string, display_name string, abstract string, publication_year int, cited_by_count bigint, referenced_works array<string>, authorships array<struct<author:struct<id:string,display_name:string>>>, venue string"
    r = serving.canonical_papers(rows(schema, ("https://openalex.org/W1", "https://doi.org/10.1/x", "T", None, 2000, None, ["a", "b"], [(("https://openalex.org/A9", "N"),)], None), (None, None, None, None, None, 1, None, None, None))).collect()
    assert (r[0].paper_id, r[0].external_ids.DOI, r[0].citation_count, r[0].reference_count, r[0].authors[0].authorId) == ("W1", "10.1/x", 0, 2, "A9")
    assert (r[1].paper_id, r[1].reference_count, r[1].authors) == ("", 0, [])


def test_authors_without_id_get_a_stable_one(rows):
    papers = rows("paper_id string, authors array<struct<authorId:string,name:string>>", ("p", [(None, "A"), ("7", "B"), ("", "A")]))
    first = [tuple(r) for r in tables.authors_table(papers).collect()]
    assert first == [tuple(r) for r in tables.authors_table(papers).collect()]
    assert first[1] == ("p", "7", "B") and len({r[1] for r in first}) == 3


def test_answers(rows):
    names = [*(f"{n}:string" for n in training.ANALYSIS_FIELDS), "limitations:array<string>"], [*(f"{n}:string" for n in training.COMPARISON_FIELDS), "remaining_limitations:array<string>"]
    schema = f"id int, answer struct<selected_predecessor_id:string,target_analysis:struct<{','.join(names[0])}>,comparison:struct<{','.join(names[1])}>>"
    full = ((*"abcdefg", ["l"]), (*"abcd", None))
    table = rows(schema, (1, ("p", *full)), (2, (None, full[0], (None,) * 5)), (3, ("", *full)), (4, ("p", (*"abcdef", "", []), full[1])), (5, None))
    assert [r[0] for r in table.orderBy("id").select(training.is_answer_valid(F.col("answer"))).collect()] == [True, True, False, False, False]
    flat = training.flattened(table).orderBy("id").collect()
    assert flat[1].what_was_improved == "" and flat[0].limitations == ["l"] and flat[4].selected_predecessor_id is None


def flaky(prompt):
    if prompt == "bad":
        raise RuntimeError("no")
    return prompt.upper()


def test_inference_retries_and_reports(rows):
    found = {r.sample_id: r for r in training.infer(rows("sample_id string, input_text string", ("a", "x"), ("b", "bad"), ("c", None)), flaky, attempts=3).collect()}
    assert (found["a"].raw_prediction, found["a"].attempts, found["a"].error) == ("X", 1, None)
    assert (found["b"].raw_prediction, found["b"].attempts, found["b"].error) == (None, 3, "RuntimeError: no")
    assert found["c"].raw_prediction == ""


def test_registry(rows):
    table = rows("version string, stage string, registered_at string, updated_at timestamp", ("1", "production", "2026-01-01", None), ("2", "staging", "2026-01-02", None))
    now = F.lit(datetime.datetime(2026, 2, 1))
    assert {(r.version, r.stage) for r in training.promote(table, "2", "production", now).collect()} == {("1", "archived"), ("2", "production")}
    assert [r.version for r in training.rollback_candidates(table, "2").collect()] == ["1"]
    assert report.latest_version(rows("version string", ("9",), ("10",), ("x",))).first().version == "10"
    won = rows("model string, composite double", ("m", 0.8))
    assert evaluate.promotion(won, rows("composite double")).first().promote
    assert not evaluate.promotion(won, rows("composite double", (0.8,))).first().promote


def test_retry_rows(rows):
    found = merge.failure_rows(rows("paper_id string, status string, error string", ("a", "", "Timeout " + "x" * 80), ("b", "gone", None))).orderBy("paper_id").collect()
    assert (found[0].status, found[0].timeout_sec, len(found[0].reason)) == ("download_failed", 140.0, 64)
    assert (found[1].reason, found[1].timeout_sec) == ("gone", 120.0)
    queue = rows("paper_id string, status string, fetch_url string, reason string, fail_runs int, retry_after timestamp, last_attempt_at timestamp, alerted boolean", ("a", "s", "u", "r", 5, None, None, False))
    now = datetime.datetime(2026, 1, 1)
    new = merge.upsert_failures(queue, rows("paper_id string, status string, fetch_url string, reason string", ("a", "s2", "u2", "r2"), ("n", "s", "u", "r")), F.lit(now))
    assert {(r.paper_id, r.fail_runs, r.retry_after) for r in new.collect()} == {("a", 6, now + datetime.timedelta(seconds=30)), ("n", 1, now + datetime.timedelta(seconds=30))}
    assert merge.alert_pending(new).count() == 1 and merge.alert_pending(merge.mark_alerted(new)).count() == 0


def test_texts(spark):
    one = lambda *c: spark.range(1).select(*c).first()
    assert one(text.domain_of(F.lit("On PHYSICS and mathematics")), text.domain_of(F.lit("x")))[:] == ("Physics", "Other")
    assert one(text.popularity_in_text(F.lit('{"citationCount": 1500}')), text.popularity_in_text(F.lit("citations: 5")), text.popularity_in_text(F.lit("none")))[:] == ("high", "low", "unknown")
    assert one(text.candidate_ids(F.lit("paper_id: ab1, paperId=cd2 paper_id: ab1")))[0] == ["ab1", "cd2"]
    assert one(text.venue_type(F.lit("NAACL 2020")), text.venue_type(F.lit("NeurIPS")), text.venue_type(F.lit(None).cast("string")))[:] == ("top_conference", "other", "arxiv")
    assert one(text.model_cost(F.lit(100_000), F.lit(1000)), text.model_cost(F.lit(300_000), F.lit(0)))[:] == (pytest.approx(0.135), pytest.approx(0.75))
    doc = text.paper_document(F.lit("T"), F.lit("A"), F.array(F.struct(F.lit("S").alias("name"), F.lit("x").alias("text"))), 12)
    assert one(doc)[0] == "# T\n\nA\n\n## S"
    listed = F.array(F.struct(F.lit("C").alias("title"), F.array(*[F.lit(str(n)) for n in range(7)]).alias("contexts")))
    assert one(text.prompt(F.lit("T"), F.lit("body"), listed))[0].count("   - ") == 5
    assert one(ids.pdf_name(F.lit("a:b"), F.lit("2020-03-01")), ids.pdf_name(F.lit("x"), F.lit(None).cast("string")))[:] == ("2020_03_a_b.pdf", "0_0_x.pdf")
    assert one(ids.text_source(("html", F.lit("")), ("pdf", F.lit(None).cast("string")), ("abstract", F.lit("t"))).alias("s")).s[:] == ("t", "abstract")


def test_drift_extensions(rows):
    t = datetime.datetime(2026, 1, 1)
    events = rows("k string, ts timestamp", *[("a", t + datetime.timedelta(minutes=m)) for m in (0, 10, 100)], ("b", t))
    assert sorted((r.k, r.n) for r in drift.sessions(events, "k", "ts").collect()) == [("a", 1), ("a", 2), ("b", 1)]
    assert [r.n for r in drift.day_over_day(events, "ts").collect()] == [4]


def test_runs_are_written_under_their_id(rows, tmp_path, spark):
    path = readers.write_run(rows("x int", (1,)), rows("n int", (1,)), str(tmp_path), "r1")
    assert spark.read.json(f"{path}/samples").count() == 1
    with pytest.raises(ValueError):
        readers.write_run(rows("x int"), rows("n int", (1,)), str(tmp_path), "r2")
    readers.write_splits(rows("split string, x int", ("train", 1), ("test", 2)), str(tmp_path / "s"))
    assert {p.name for p in (tmp_path / "s").iterdir() if p.is_dir()} == {"split=train", "split=test"}
