"""Merge on read against merging all batches at once."""

from __future__ import annotations

import random

import pytest

from citemill.operators.keyed_table import KeyedTable

SCHEMA = "id string, at long, name string, first_seen long, hits long"


def table(spark, folder, buckets=8):
    return KeyedTable(spark, str(folder), SCHEMA, "id", "at", {"first_seen": "first", "hits": "sum"}, buckets)


def merged(*batches):
    found = {}
    for batch in batches:
        for id_, at, name, seen, hits in sorted(batch, key=lambda r: r[1]):
            if id_ is None:
                continue
            last = found.get(id_)
            newer = last is None or at >= last[0]
            found[id_] = (at if newer else last[0], name if newer else last[1], seen if last is None else last[2], hits + (last[3] if last else 0))
    return {(k, *v) for k, v in found.items()}


def rows_of(df):
    found = [tuple(r) for r in df.collect()]
    assert len(found) == len(set(found))
    return set(found)


def batch(r, n, ids):
    return [(f"p{r.randrange(ids)}", at, r.choice(("x", "y", None)), r.randrange(99), r.randrange(5)) for at in r.sample(range(10_000), n)]


def test_batches_compaction_and_vacuum(spark, tmp_path):
    r, t = random.Random(1), table(spark, tmp_path)
    batches = [batch(r, 400, 300), batch(r, 30, 300), [], batch(r, 5, 300), [(None, 1, "x", 1, 1)], batch(r, 60, 900)]
    for n, rows in enumerate(batches[:2]):
        t.upsert(spark.createDataFrame(rows, SCHEMA))
        assert rows_of(t.read()) == merged(*batches[: n + 1])
    assert t.compact() == list(range(8))
    assert rows_of(t.read()) == merged(*batches[:2])
    for n, rows in enumerate(batches[2:], 3):
        t.upsert(spark.createDataFrame(rows, SCHEMA))
        assert rows_of(t.read()) == merged(*batches[:n])
    _, runs, _ = t._version()
    # A batch writes its own keys only.
    assert [sum(x["rows"].values()) for x in runs if not x["base"]] == [len({k for k, *_ in b}) for b in (batches[3], batches[5])]
    assert t.vacuum() == 4  # two that were compacted, and two without rows
    assert rows_of(t.read()) == merged(*batches)
    asked = spark.createDataFrame([("p1",), ("p2",), ("none",)], "id string")
    assert rows_of(t.read(asked)) == {x for x in merged(*batches) if x[0] in ("p1", "p2")}


def test_compaction_takes_the_grown_buckets_alone(spark, tmp_path):
    t = table(spark, tmp_path)
    rows = [(f"p{i}", 1, "x", 1, 1) for i in range(200)]
    t.upsert(spark.createDataFrame(rows, SCHEMA))
    t.compact()
    before = {x["path"] for x in t._version()[1]}
    change = [("p7", 2, "y", 2, 2)]
    t.upsert(spark.createDataFrame(change, SCHEMA))
    assert t.compact(0.5) == [] and len(t.compact(0.0)) == 1
    _, runs, _ = t._version()
    assert before < {x["path"] for x in runs} and all(x["base"] for x in runs)
    assert rows_of(t.read()) == merged(rows, change)


def test_repeated_batches_and_two_writers(spark, tmp_path):
    t = table(spark, tmp_path)
    rows = [("a", 1, "x", 1, 1)]
    for _ in range(2):
        t.upsert(spark.createDataFrame(rows, SCHEMA), 0)
    assert rows_of(t.read()) == {("a", 1, "x", 1, 1)}
    version, runs, seen = t._version()
    t.upsert(spark.createDataFrame(rows, SCHEMA), 1)
    with pytest.raises(RuntimeError):
        t._commit(version + 1, runs, seen)
    assert rows_of(t.read()) == {("a", 1, "x", 1, 2)}


def test_empty_table(spark, tmp_path):
    t = table(spark, tmp_path)
    assert t.read().collect() == [] and t.compact() == [] and t.read().columns == [c.split()[0] for c in SCHEMA.split(", ")]
