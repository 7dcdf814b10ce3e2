"""Validation, cleaning, features, quality, merges and parsing on small rows."""

from __future__ import annotations

import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from citemill.functions import ids, metrics, parsing, text
from citemill.operators import anomaly, clean, evaluate, features, merge, quality, validate
from citemill.plans import pipeline
from citemill.sources import readers

PAPER = "paper_id string, title string, year int, citation_count bigint, influential_count bigint, reference_count bigint, abstract string, venue string, pos int"


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_first_failing_rule_names_the_error(rows):
    table = rows(PAPER, *[(i, t, y, c, 0, 0, "", "", n) for n, (i, t, y, c) in enumerate([("a", "t", 2020, 1), ("", "t", 1, 1), (None, None, 2020, 1), ("b", "", 2020, 1), ("c", "t", 1899, -1), ("d", "t", 2031, 0), ("e", "t", None, -1), ("f", "t", 0, 0), ("g", "t", 2000, None)])])
    found = [r[0] for r in table.orderBy("pos").select(validate.paper_error(table)).collect()]
    assert found == [None, "Missing paperId", "Missing paperId", "Missing title", "Invalid year: 1899", "Invalid year: 2031", "Negative citationCount: -1", None, "Invalid citationCount type"]
    typed = rows("paper_id string, title string, year string, citation_count string", ("a", "t", "20x", "1"), ("a", "t", "2020", "1.5"), ("a", "t", "2020", "5"))
    assert [r[0] for r in typed.select(validate.paper_error(typed)).collect()] == ["Invalid year type", "Invalid citationCount type", None]


def test_gates(rows, spark):
    papers = rows(PAPER, *[(str(i), "t", 2000, 1, 0, 0, "", "", i) for i in range(8)], ("", "t", 2000, 1, 0, 0, "", "", 9))
    edges = rows("pos int, from_id string, to_id string, is_influential boolean", (1, "1", "2", True))
    with pytest.raises(validate.ValidationFailed):
        validate.check_error_rate(validate.validation_report(papers.filter("pos > 6"), edges, edges))
    assert validate.check_error_rate(validate.validation_report(papers, edges, edges)) == pytest.approx(1 / 11)
    with pytest.raises(validate.ValidationFailed):
        validate.check_request(" ", 3, "both")
    assert validate.check_request("x", 0, "both") == 3


def test_cleaning(rows):
    papers = rows(PAPER, ("a", "  Two  words\u0007 ", 2000, -5, 1, 1, None, "Proc. Int'l Conf on X", 1), ("a", "later", 2001, 1, 1, 1, "", "", 2), ("b", "b", None, 1, 1, 1, "", None, 3))
    found = {r.paper_id: r for r in clean.clean_papers(papers).collect()}
    assert (found["a"].title, found["a"].venue, found["a"].citation_count, found["a"].year) == ("Two words", "Proceedings. International Conference on X", 0, 2000)
    edges = rows("pos int, from_id string, to_id string", (1, "a", "b"), (2, "a", "b"), (3, "a", "a"), (4, "a", "zz"), (5, None, None))
    assert [r.pos for r in clean.clean_edges(edges, papers).collect()] == [1]


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(max_size=30), min_size=1, max_size=5))
def test_clean_text_is_like_python_and_idempotent(spark, texts):
    table = spark.createDataFrame([(t,) for t in texts], "t string")
    for t, c, again in table.select("t", text.clean_text(F.col("t")), text.clean_text(text.clean_text(F.col("t")))).collect():
        controls = {chr(n) for n in [*range(32), *range(127, 160)]}
        assert c == "".join(x for x in " ".join(t.split()) if x not in controls)
        assert again == " ".join(c.split())


def test_features(rows):
    papers = rows(PAPER, ("old", "t", 1990, 360, 2, 0, "", "", 1), ("new", "t", 2026, None, None, 0, "", "", 2), ("none", "t", None, 10, 0, 0, "", "", 3), ("near", "t", 2014, 0, 0, 0, "", "", 4))
    found = {r.paper_id: r for r in features.paper_features(papers, 2017, 2026).collect()}
    assert (found["old"].paper_age, found["old"].citation_velocity, found["old"].recency_score, found["old"].temporal_category) == (36, 10.0, 0.0, "foundational")
    assert found["old"].influence_score_raw == 360 + 20 + 1000
    assert (found["none"].paper_age, found["none"].years_from_target, found["none"].temporal_category) == (1, 0, "contemporary")
    assert (found["new"].temporal_category, found["near"].temporal_category) == ("subsequent", "recent_predecessor")
    assert [r.x for r in features.normalize(papers.filter("pos = 1"), "citation_count", "x").collect()] == [0.5]


def test_quality_counts_every_check(rows):
    papers = rows(PAPER, ("a", "t", 2012, 50, 1, 1, "", "NeurIPS", 1), ("b", "t", None, 500, 1, 1, "", "", 2), ("c", None, 2016, 5000, 1, 1, "", "Journal of X", 3))
    authors = rows("paper_id string, author_name string", ("a", "x"), ("zz", ""))
    edges = rows("pos int, from_id string, to_id string", (1, "a", "b"), (2, "a", "b"), (3, "a", "zz"))
    checks = quality.all_checks(papers, authors, edges)
    counts = {tuple(r)[:3]: r["count"] for r in checks.groupBy("category", "entity", "passed").count().collect()}
    assert counts[("schema", "paper", True)] == 1 and counts[("schema", "paper", False)] == 1  # the year hides b
    assert checks.count() == (2 + 2 + 3) + (3 + 3 + 3) + (2 + 3) + (5 + 2 + 1)
    kinds = {r.slice: round(r.share, 3) for r in quality.slices(papers).filter("dimension = 'venue'").collect()}
    assert kinds == {"top_conference": 0.0, "journal": 0.333, "arxiv": 0.333, "other": 0.333}  # mixed-case names never match
    with pytest.raises(quality.QualityTooLow):
        quality.check_quality(quality.quality_report(checks))


def test_anomalies(rows):
    papers = rows(PAPER, *[(str(i), "t", 2000, 10, 0, 0, "x", "v", i) for i in range(10)], ("big", "t", 0, 100000, 0, 0, "", None, 11))
    edges = rows("pos int, from_id string, to_id string", (1, "1", "1"), (2, "1", "2"), (3, "1", "2"), (4, "1", "2"))
    assert [r.paper_id for r in anomaly.outliers(papers).collect()] == ["big"]
    assert anomaly.outliers(papers.limit(2)).count() == 0
    counts = {r.anomaly: r["count"] for r in anomaly.all_anomalies(papers, edges).groupBy("anomaly").count().collect()}
    assert counts == {"missing_abstracts": 1, "missing_years": 1, "missing_venues": 1, "citation_outliers": 1, "self_citations": 1, "duplicate_citations": 2, "disconnected_papers": 9}


def test_upsert_counts_each_duplicate(rows):
    schema = "paper_id string, title string, citation_count bigint, influential_count bigint, reference_count bigint, query_count int"
    old = rows(schema, ("a", "kept", 1, 1, 1, 4), ("b", "b", 1, 1, 1, 1))
    new = rows("pos int, paper_id string, title string, citation_count bigint, influential_count bigint, reference_count bigint", (1, "a", "x", 5, 5, 5), (2, "a", "y", 6, 6, 6), (3, "n", "n", 2, 2, 2))
    assert {tuple(r) for r in merge.upsert_papers(old, new).collect()} == {("a", "kept", 6, 6, 6, 6), ("b", "b", 1, 1, 1, 1), ("n", "n", 2, 2, 2, 1)}


def test_merge_matches_null_keys_and_swap_is_atomic(rows, spark, tmp_path):
    old, new = rows("k string, v int", (None, 1), ("a", 1)), rows("k string, v int", (None, 2), ("b", 3))
    merged = merge.merge(old, new, ["k"], {"v": F.col("n.v")})
    assert {tuple(r) for r in merged.collect()} == {(None, 2), ("a", 1), ("b", 3)}
    merge.swap(spark, {"t": merged}, str(tmp_path))
    merge.swap(spark, {"t": merge.current(spark, str(tmp_path), "t").filter("v > 1")}, str(tmp_path))
    assert merge.current(spark, str(tmp_path), "t").count() == 2


def test_serving_papers_backfill_only(rows):
    schema = "paper_id string, arxiv_id string, source_type string"
    found = merge.upsert_serving_papers(rows(schema, ("a", None, "x"), ("b", "old", "x")), rows(schema, ("a", "new", "y"), ("b", "new", "y")))
    assert {tuple(r) for r in found.collect()} == {("a", "new", "y"), ("b", "old", "y")}


@pytest.mark.parametrize(
    "raw,wanted",
    [(" https://arxiv.org/pdf/1706.03762v5 ", "ARXIV:1706.03762"), ("1706.03762v2", "ARXIV:1706.03762v2"), ("hep-th/9901001", "ARXIV:hep-th/9901001"), ("ARXIV:1706.03762", "ARXIV:1706.03762"), ("649def34", "649def34")],
)
def test_identifiers(raw, wanted, spark):
    assert one(spark, ids.normalize_id(F.lit(raw)))[0] == wanted


def test_catalog_ids(spark):
    external = F.expr("named_struct('DOI', '', 'ArXiv', cast(null as string), 'OpenAlex', 'W1')")
    assert one(spark, ids.doi_of(external, F.lit("https://doi.org/10.1/x")))[0] == "10.1/x"
    assert one(spark, ids.openalex_of(external, F.lit("https://openalex.org/W99/")))[0] == "W99"
    assert one(spark, ids.openalex_of(external, F.lit("other")))[0] == "W1"
    assert one(spark, ids.is_pdf(F.lit(b"%PDF-" + b"x" * 2000)), ids.is_pdf(F.lit(b"%PDF-")))[:] == (True, False)


def test_json_repair_and_output_parsing(spark):
    assert parsing.repaired('```json\n{"a": [1, 2,], "b": {"c": 1,}\n```') == '{"a":[1,2],"b":{"c":1}}'
    assert parsing.repaired("no json") is None and parsing.repaired("") is None
    assert parsing.repaired('{"a": "x, ]",\n"b": "y \\" }"\n"c": [1\n2, "z",') == json.dumps({"a": "x, ]", "b": 'y " }', "c": [1, 2, "z"]}, separators=(",", ":"))
    assert parsing.repaired('{"a": 1,, "b": [] "c": {}} and {"d": 2}') == '{"a":1,"b":[],"c":{}}'
    assert parsing.repaired('{"a": "open') is None and parsing.repaired("[1}") is None
    good, error = parsing.parsed_output('text {"a": "x"\n "b": [1]} tail')
    assert json.loads(good) == {"a": "x", "b": [1]} and error is None
    assert parsing.parsed_output("{bad")[1].startswith("JSON parse error")
    # Brackets of prose before the value, in a fence or without one; numbers without a comma; a list only where no object is.
    assert parsing.parsed_output('Per [1], here:\n```json\n{"a": 1}\n```')[0] == '{"a":1}'
    assert parsing.parsed_output('```\n{"a": [1 2]}\n```')[0] == '{"a":[1,2]}'
    assert parsing.parsed_output('As {x} said in [2]: {"a": 1}')[0] == '{"a":1}'
    assert parsing.parsed_output('See {"b": 2} or\n```json\n{"a": true "c": null,\n```')[0] == '{"a":true,"c":null}'
    assert parsing.parsed_output("See [1 2] there")[0] == "[1,2]" and parsing.parsed_output("[1]")[0] == "[1]"
    assert parsing.parsed_output('{"a": {"b": 1}, ...: }')[0] is None
    assert parsing.parsed_output('{"a": "```\nx"')[0] is None and parsing.parsed_output('so: {"a": "```x```"}')[0] == '{"a":"```x```"}'
    assert parsing.parsed_output("[" * 20_000 + "{" * 20_000)[0] is None
    assert one(spark, parsing.parse_output(F.lit('{"a": 1}')).alias("p")).p.parsed == '{"a":1}'
    title, abstract, sections = parsing.document_of("<title>T</title><h2>Abstract</h2><p>Short.</p><h2>1. Intro</h2><p>One &amp; two</p><script>x</script><h3>2.1 Sub</h3>three")
    assert (title, abstract, sections) == ("T", "Short.", [("Intro", "One & two"), ("Sub", "three")])


def test_schema_errors(spark):
    good = {"target_analysis": {"breakthrough_level": "Major", "limitations": ["x"]}, "comparison": {"remaining_limitations": ["y"]}, "selected_predecessor_id": None, "secondary_influences": [{"paper_id": "p"}]}
    errors = lambda x: one(spark, evaluate.schema_errors(F.lit(x)))[0]
    assert errors(json.dumps(good)) == []
    assert errors("nonsense") == ["prediction is not a dict"]
    bad = good | {"secondary_influences": [{}], "target_analysis": {"breakthrough_level": "tiny", "limitations": []}}
    assert len(errors(json.dumps(bad))) == 3
    del bad["comparison"]
    assert any("missing top-level key: 'comparison'" in e for e in errors(json.dumps(bad)))


def test_scores(spark):
    a = lambda *x: F.array(*map(F.lit, x)) if x else F.array().cast("array<string>")
    assert one(spark, metrics.set_f1(a(), a()), metrics.set_f1(a("x"), a()), metrics.set_f1(a("x", "y", "y"), a("y", "z")))[:] == (1.0, 0.0, 0.5)
    assert one(spark, metrics.reciprocal_rank(F.lit("t"), F.lit("p"), a("q", "t")), metrics.reciprocal_rank(F.lit(None).cast("string"), F.lit("p"), a()))[:] == (pytest.approx(1 / 3), 0.0)
    assert one(spark, metrics.cosine(a(1.0, 0.0), a(0.0, 0.0)))[0] == 0.0
    assert one(spark, metrics.composite(F.lit(0.776), F.lit(3.09)))[0] == pytest.approx(0.7365)


def test_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"x": 1}\n\n{"x": 2}\n')
    assert readers.json_lines(spark, str(tmp_path / "a.jsonl"), "x int").count() == 2 and readers.line_count(spark, str(tmp_path / "a.jsonl")) == 2
    (tmp_path / "b.jsonl").write_text('{"x": 1}\n{bad\n')
    assert len(readers.json_lines(spark, str(tmp_path / "b.jsonl"), "x int", strict=False).collect()) == 1
    assert readers.malformed_lines(spark, str(tmp_path / "b.jsonl"), "x int").count() == 1
    with pytest.raises(Exception):
        readers.json_lines(spark, str(tmp_path / "b.jsonl"), "x int").collect()
    (tmp_path / "seeds.json").write_text('["p1", {"paperId": "p2"}, {"paper_id": "p3"}]')
    assert [r[0] for r in readers.seeds(spark, str(tmp_path / "seeds.json")).collect()] == ["p1", "p2", "p3"]
    readers.append_new(spark.createDataFrame([("a", 1), ("a", 1)], "k string, v int"), str(tmp_path / "out"), "k", "k string, v int")
    readers.append_new(spark.createDataFrame([("a", 2), ("b", 2)], "k string, v int"), str(tmp_path / "out"), "k", "k string, v int")
    assert {tuple(r) for r in readers.json_lines(spark, str(tmp_path / "out"), "k string, v int").collect()} == {("a", 1), ("b", 2)}
    for version, name in (("1", "r1"), ("2", "r2")):
        (tmp_path / "reg" / name).mkdir(parents=True)
        (tmp_path / "reg" / name / "metadata.json").write_text(json.dumps({"version": version, "registered_at": f"2026-01-0{version}"}))
    assert [r.version for r in readers.registry(spark, str(tmp_path / "reg")).collect()] == ["2", "1"]
    assert {r.name for r in readers.blobs(spark, str(tmp_path), "*.jsonl").collect()} == {"a.jsonl", "b.jsonl"}


def test_positions_and_ground_truth(spark):
    table = readers.with_position(spark.range(0, 100, 1, 7))
    assert [(r.id, r.position) for r in table.orderBy("id").collect()] == [(i, i) for i in range(100)]
    rows = spark.createDataFrame([('{"a": 1}',), (json.dumps('{"a": 2}'),)], "g string")
    assert [r.g.a for r in readers.ground_truth(rows, "g", "a int").collect()] == [1, 2]


def test_whole_pipeline(rows):
    papers = rows(PAPER, *[(f"p{n}", f"title {n}", y, c, 1, 1, "abstract", v, n) for n, (y, c, v) in enumerate([(1998, 50, "NIPS"), (2005, 150, "Journal of A"), (2012, 1500, ""), (2017, 50000, "ICML"), (2022, 10, "other")])])
    edge = "pos int, from_id string, to_id string, is_influential boolean, intents array<string>, direction string"
    refs = rows(edge, (1, "p3", "p2", True, ["methodology"], "backward"), (2, "p3", "p1", False, ["background"], "backward"))
    cits = rows(edge, (1, "p4", "p3", False, [], "forward"))
    authors = rows("paper_id string, author_name string", *[(f"p{n}", f"a{n}") for n in range(5)])
    result = pipeline.run(pipeline.Network(papers, refs, cits), authors, 2017, 2026)
    assert result.features.count() == 5 and result.citations.count() == 3
    assert result.quality.first().quality_score >= 0.85
    assert {r.paper_id for r in result.features.filter("in_degree + out_degree = 0").collect()} == {"p0"}
    assert result.totals.first()[:] == (5, 5, 3)
