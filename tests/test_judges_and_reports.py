"""Judge scores, reports of both forms, and checks of requests and payloads, on small rows with gaps."""

from __future__ import annotations

import datetime
import json

import pytest
from pyspark.sql import functions as F

from citemill.functions.text import parsed_time
from citemill.operators import evaluate, sketches, validate


def test_judge_scores(rows):
    texts = ['```json\n{"overall": 4, "specificity": 3.5, "reasoning": "r"}\n```', '{"overall": "5"}', '{"overall": 5, "specificity": null}', "[4]", "none", None, '{"overall": {"x": 1}}', "{}"]
    found = evaluate.judge_scores(rows("id int, response string", *enumerate(texts))).orderBy("id").collect()
    assert [(r.score, r.specificity, r.factual_grounding) for r in found] == [(4.0, 3.5, -1.0), (5.0, -1.0, -1.0), *[(-1.0, -1.0, -1.0)] * 6]
    assert [r.reasoning.startswith("Judge call failed") for r in found] == [False, False, True, True, True, True, True, False]
    assert found[0].reasoning == "r" and found[7].reasoning == "{}"


def test_samples_with_missing_fields_count_failed_ones(rows):
    fields = evaluate.JUDGED_FIELDS
    data = [("a", f, json.dumps({"overall": n + 1})) for n, f in enumerate(fields)] + [("b", fields[0], '{"overall": 4}'), ("b", fields[0], '{"overall": 2}'), ("b", "other", '{"overall": 5}')]
    found = {r.sample_id: r for r in evaluate.judged_samples(rows("sample_id string, field string, response string", *data)).collect()}
    assert found["a"].judge == 3.0 and found["b"].judge == pytest.approx((4 - 4) / 5) and found["b"][fields[0]] == 4.0


def test_reports_of_both_forms(rows):
    new = {"overall_classification": {"predecessor_strict": 0.5, "predecessor_soft": 0.75, "n": 4}, "overall_judge": {"judge_overall": 4.0}, "aggregate": {"predecessor_accuracy": 0.1}}
    old = {"aggregate": {"predecessor_accuracy": 0.25, "secondary_influences_f1_mean": 0.5, "n_schema_errors": 1, "n_samples": 4, "judge_overall_mean": 2.5}}
    bare = {"aggregate": {"predecessor_accuracy": 0.25}}
    table = rows("model string, report string", ("new", json.dumps(new)), ("old", json.dumps(old)), ("bare", json.dumps(bare)), ("empty", "{}"), ("bad", "x"), ("null", None))
    found = {r.model: r for r in evaluate.normalized_reports(table).collect()}
    assert (found["new"].strict, found["new"].soft, found["new"].judge, found["new"].n_samples, found["new"].is_converted) == (0.5, 0.75, 4.0, 4, False)
    assert (found["old"].strict, found["old"].soft, found["old"].f1, found["old"].schema_valid, found["old"].judge, found["old"].is_converted) == (0.25, 0.25, 0.5, 0.75, 2.5, True)
    assert (found["bare"].soft, found["bare"].schema_valid, found["bare"].n_samples) == (0.25, 1.0, 0)
    assert all((found[m].soft, found[m].judge, found[m].n_samples, found[m].is_converted) == (0.0, 0.0, 0, False) for m in ("empty", "bad", "null"))


def test_requests_and_payloads(rows):
    requests = rows("p string, d int, w string", ("a", None, "both"), ("a", 0, "backward"), (" ", 9, "x"), (None, 1, "both"), ("a", 6, "both"), ("a", -1, "both"), ("a", 5, None))
    found = requests.select(validate.used_depth(F.col("d")).alias("d"), validate.request_errors(F.col("p"), F.col("d"), F.col("w")).alias("e")).collect()
    assert [r.d for r in found] == [3, 3, 9, 1, 6, -1, 5]
    assert [r.e and r.e.split()[0] for r in found] == [None, None, "paper_id", "paper_id", "max_depth", "max_depth", "direction"]
    whole = {"target_paper_id": "t", "papers": [{}], "references": [], "citations": []}
    texts = [json.dumps(whole), json.dumps(whole | {"papers": []}), json.dumps(whole | {"papers": None}), json.dumps({k: v for k, v in whole.items() if k != "papers"}), "[]", None]
    errors = [r[0] for r in rows("i int, x string", *enumerate(texts)).orderBy("i").select(validate.payload_errors(F.col("x"))).collect()]
    assert errors[:4] == [None, "no papers", "no papers", "missing papers"] and all(e.startswith("missing citations") for e in errors[4:])


def test_times_and_sketches(rows, spark):
    now = datetime.datetime(2026, 1, 1)
    found = rows("x string", ("2025-02-03 04:05:06",), ("2025-02-03",), ("soon",), (None,)).select(parsed_time(F.col("x"), F.lit(now)).alias("t")).collect()
    assert [r.t for r in found] == [datetime.datetime(2025, 2, 3, 4, 5, 6), datetime.datetime(2025, 2, 3), now, now]
    start = datetime.datetime(2026, 1, 1)
    data = spark.range(60_000).select((F.lit(start) + F.make_dt_interval(F.col("id") % 6)).alias("ts"), (F.col("id") % 3).alias("kind"), (F.col("id") % 20_000).alias("who"))
    daily = sketches.daily_sketches(data, "ts", "kind", "who")
    assert daily.count() == 6  # of six days each has one kind
    union = sketches.distinct_in(daily).first()
    assert union.n == 60_000 and abs(union.n_distinct - 20_000) <= 3 * sketches.relative_error() * 20_000
    some = sketches.distinct_in(daily.filter("day < '2026-01-03'")).first()
    exact = data.filter("ts < '2026-01-03'").select("who").distinct().count()
    assert abs(some.n_distinct - exact) <= 3 * sketches.relative_error() * exact
