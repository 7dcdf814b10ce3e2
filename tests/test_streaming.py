"""Streams against their batch counterparts."""

from __future__ import annotations

import datetime
import json

from pyspark.sql import functions as F

from citemill.operators.keyed_table import KeyedTable
from citemill.streaming import logs, queue
from citemill.streaming.state import run_available


def test_multiline_and_dissect(rows):
    lines = rows("file string, line_no int, value string", ("a", 1, "[2026-01-01] {x.py:1} ERROR - first"), ("a", 2, "  trace"), ("a", 3, "[2026-01-02] {y.py:2} INFO - second"), ("b", 1, "stray"))
    found = [(r.file, r.level, r.message) for r in logs.dissected(logs.multiline(lines)).orderBy("file", "line_no").collect()]
    assert found == [("a", "ERROR", "first\n  trace"), ("a", "INFO", "second"), ("b", None, "stray")]


def test_tail_routes_by_day(spark, tmp_path):
    (tmp_path / "in").mkdir()
    good = [{"ts": "2026-01-01T00:00:00Z", "level": "INFO", "message": "m"}, {"ts": "2026-01-02T00:00:00Z", "level": "ERROR", "message": "n"}]
    (tmp_path / "in" / "x.ndjson").write_text("\n".join([*map(json.dumps, good), "{bad", ""]))
    q = logs.route(logs.tail(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"), F.lit("app"))
    q.awaitTermination(120)
    back = spark.read.json(str(tmp_path / "out"))
    assert back.count() == 3 and back.filter("error = 'json' and message = '{bad'").count() == 1
    assert sorted(p.name for p in (tmp_path / "out" / "log_type=app").iterdir())[:2] == ["day=2026-01-01", "day=2026-01-02"]


def at(minutes):
    return datetime.datetime(2026, 1, 1) + datetime.timedelta(minutes=minutes)


RESULTS = "paper_id string, ts timestamp, status string, code int"


def fed(spark, folder, schema, query, *batches):
    """What a query with state tells in all, for rows that arrive batch by batch."""
    for number, data in enumerate(batches):
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        run_available(query(spark.readStream.schema(schema).parquet(f"{folder}/in")), f"{folder}/out", f"{folder}/cp")
    return spark.read.parquet(f"{folder}/out").collect()


def test_retry_events(spark, tmp_path):
    data = [("a", at(n), "download_failed", 500) for n in range(7)] + [("b", at(0), "download_failed", 500), ("b", at(1), "download_failed", 404), ("c", at(0), "gcs_upload_failed", 0), ("c", at(1), "download_failed", 404), ("d", at(0), "uploaded", 200)]
    events = [(r.paper_id, r.event, r.fail_runs) for r in fed(spark, tmp_path, RESULTS, queue.retry_events, data)]
    assert [e for e in events if e[0] == "a" and e[1] == "alert"] == [("a", "alert", 6)]
    assert sorted(e[1] for e in events if e[0] == "b") == ["deleted", "due", "retry"]
    assert sorted(e[1:] for e in events if e[0] == "c") == [("due", 1), ("due", 2), ("retry", 1), ("retry", 2)]
    assert ("d", "done", 0) in events


def test_retry_falls_due_by_itself_and_is_forgotten(spark, tmp_path):
    """Paper a gets one result only. Results of other papers move the time on; then its retry is told, at its time, and 48 hours later
    its state is gone."""
    late = [("z", at(48 * 60 + 30), "uploaded", 200)]
    first, second = [("a", at(0), "download_failed", 500), ("b", at(0), "uploaded", 200)], [("z", at(2), "uploaded", 200)]
    told = {(r.paper_id, r.event, r.at) for r in fed(spark, tmp_path, RESULTS, queue.retry_events, first)}
    assert told == {("a", "retry", at(0.5)), ("b", "done", at(0))}
    told = {(r.paper_id, r.event, r.at) for r in fed(spark, tmp_path, RESULTS, queue.retry_events, second)}
    assert ("a", "due", at(0.5)) in told and not any(e == "forgotten" for _, e, _ in told)
    held = spark.read.format("statestore").option("stateVarName", "queue").load(str(tmp_path / "cp"))
    assert [r.key.paper_id for r in held.collect()] == ["a"]
    told = {(r.paper_id, r.event, r.at) for r in fed(spark, tmp_path, RESULTS, queue.retry_events, late)}
    assert ("a", "forgotten", at(48 * 60)) in told and len([e for p, e, _ in told if (p, e) == ("a", "due")]) == 1
    assert spark.read.format("statestore").option("stateVarName", "queue").load(str(tmp_path / "cp")).isEmpty()


def test_retry_after_being_forgotten_starts_anew(spark, tmp_path):
    rows = [("a", at(0), "gcs_upload_failed", 0), ("a", at(1), "download_failed", 500), ("a", at(49 * 60), "download_failed", 404)]
    told = fed(spark, tmp_path, RESULTS, queue.retry_events, rows)
    assert sorted((r.event, r.fail_runs, r.timeout_sec) for r in told) == [("deleted", 0, 120.0), ("due", 1, 120.0), ("due", 2, 140.0), ("forgotten", 2, 140.0), ("retry", 1, 120.0), ("retry", 2, 140.0)]


def test_cache_reads_over_batches(spark, tmp_path):
    schema = "key string, ts timestamp, number long, put boolean, value string"
    first = [("a", at(0), 1, True, "x"), ("a", at(1), 2, False, None), ("b", at(1), 3, False, None)]
    second = [("a", at(47 * 60), 4, False, None), ("a", at(48 * 60), 5, False, None), ("b", at(48 * 60), 6, True, "y"), ("b", at(48 * 60), 7, False, None)]
    third = [("a", at(49 * 60), 8, True, None), ("a", at(49 * 60), 9, False, None)]
    found = fed(spark, tmp_path, schema, queue.cache_reads, first, second, third)
    assert sorted((r.number, r.hit, r["value"]) for r in found) == [(2, True, "x"), (3, False, None), (4, True, "x"), (5, False, None), (7, True, "y"), (9, True, None)]


def test_multiline_stream_over_batches(spark, tmp_path):
    schema = "file string, ts timestamp, line_no long, value string"
    first = [("f", at(0), 1, "stray"), ("f", at(0), 2, "[2026 a"), ("f", at(0), 3, " a2"), ("g", at(0), 1, "[2026 x")]
    second = [("f", at(0.01), 4, " a3"), ("f", at(0.02), 5, None), ("f", at(0.02), 6, "[2026 b")]
    third = [("g", at(1), 2, " too late"), ("f", at(1), 7, "[2026 c"), ("f", at(3), 8, "[2026 d")]
    found = sorted((r.file, r.line_no, r.record) for r in fed(spark, tmp_path, schema, logs.multiline_stream, first, second, third))
    assert found == [("f", 1, "stray"), ("f", 2, "[2026 a\n a2\n a3\n"), ("f", 6, "[2026 b"), ("f", 7, "[2026 c"), ("g", 1, "[2026 x"), ("g", 2, " too late")]


def test_multiline_of_a_long_file(spark):
    """A file of a million lines in a hundred lots, with a record that spans several of them, equals a plain loop."""
    n = 1_000_000
    begins = (F.xxhash64("id") % 3 == 0) & ~F.col("id").between(250_000, 290_000) & (F.col("id") > 5)
    lines = spark.range(n).select(F.lit("f").alias("file"), F.col("id").alias("line_no"), F.when(begins, F.concat(F.lit("[2026 "), "id")).otherwise(F.concat(F.lit(" +"), "id")).alias("value"))
    found = {r.line_no: r.record for r in logs.multiline(lines, lot_lines=10_000).collect()}
    wanted, head = {}, None
    for r in lines.orderBy("line_no").toLocalIterator():
        if head is None or r["value"].startswith("[20"):
            head = r.line_no
            wanted[head] = []
        wanted[head].append(r["value"])
    assert found == {k: "\n".join(v) for k, v in wanted.items()}


def test_training_runs(rows):
    day = lambda n: datetime.date(2026, 1, n)
    daily = rows("day date, n long", (day(3), 1), (day(1), 49), (day(2), 1), (day(4), 48), (day(5), 120))
    assert [tuple(r) for r in queue.training_runs(daily).orderBy("day").collect()] == [(day(1), 49, False), (day(2), 50, True), (day(3), 51, False), (day(4), 99, False), (day(5), 219, True)]


def test_windowed_counts_and_upserts(spark, tmp_path):
    data = [("a", datetime.datetime(2026, 1, 1, 0, n), n) for n in range(10)] + [("b", datetime.datetime(2026, 1, 1), 5)]
    schema = "paper_id string, ts timestamp, v int"
    for part in range(2):
        spark.createDataFrame(data[part::2], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    table = KeyedTable(spark, str(tmp_path / "out"), schema, "paper_id", "ts", buckets=4)
    queue.upsert_batches(stream, table, str(tmp_path / "cp")).awaitTermination(120)
    assert {(r.paper_id, r.v) for r in table.read().collect()} == {("a", 9), ("b", 5)}
    w = logs.counts(stream, "paper_id").writeStream.format("memory").queryName("counted").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    w.awaitTermination(120)
    assert sum(r.n for r in spark.table("counted").collect()) == 11
    assert queue.enough_new(60, 10) and not queue.enough_new(59, 10)


def test_expiry(rows):
    t = datetime.datetime(2026, 1, 1)
    cache = queue.with_expiry(rows("k string, written_at timestamp", ("a", t), ("b", t - datetime.timedelta(hours=49))))
    assert [r.k for r in queue.live(cache, F.lit(t)).collect()] == ["a"]
