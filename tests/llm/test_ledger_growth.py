"""The ledger on span-rich texts, and what its second scan reads."""

import re
import time

import pytest
from pyspark.sql import functions as F

from citemill.llm import secret_ledger
from citemill.llm.secret_ledger import BASE_RULES, RULE_VERSIONS, BlobLedger, rule_spans, running_sums


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 1000])
def test_running_sums(spark, n):
    numbers = [k % 7 for k in range(n)]
    row = spark.createDataFrame([(numbers,)], "x array<int>").select(running_sums(F.col("x")).alias("s")).first()
    assert row.s == [sum(numbers[: k + 1]) for k in range(n)]


def test_time_grows_with_the_spans(spark):
    took = []
    for n in (4_000, 40_000, 400_000):
        start = time.time()
        text = spark.range(1).select(F.repeat(F.lit("token=abcdefgh "), n).alias("text"))
        found = text.select(rule_spans(F.col("text"), BASE_RULES[0]).alias("s")).select(F.size("s").alias("n"), F.element_at("s", -1).alias("last")).first()
        took.append(time.time() - start)
        assert found.n == n and (found.last.start, found.last.end) == (15 * n - 15, 15 * n - 1)
    assert took[2] < 12 * took[1] + 2


def test_versions_are_scanned_one_by_one(spark):
    """Rule version 2 takes only its own pairs; changed and new paths only what they bring."""
    docs = spark.createDataFrame([(1, "token=abcdefgh"), (2, "token=abcdefgh"), (3, "x -----BEGIN PRIVATE KEY-----"), (4, None)], "path long, text string")
    ledger = BlobLedger(spark)
    ledger.scan(docs, rule_versions={1: RULE_VERSIONS[1]})
    assert ledger.findings().count() == 3
    pending = ledger.pending(ledger.addressed(docs), [1, 2])
    assert [r.missing for r in pending.select("missing").distinct().collect()] == [[2]]
    found = {r.path: [(s.kind, s.start, s.end) for s in r.spans] for r in ledger.scan(docs).collect()}
    assert found == {1: [("assign", 0, 14)], 2: [("assign", 0, 14)], 3: [("pem", 2, 29)], 4: []}
    assert ledger.findings().groupBy("blob", "rule_version").count().filter("count > 1").isEmpty() and ledger.findings().count() == 6
    more = docs.union(spark.createDataFrame([(5, "secret: abcdefgh"), (5, "secret: abcdefgh")], docs.schema))
    found = [(r.path, len(r.spans)) for r in ledger.scan(more).collect()]
    assert sorted(found) == [(1, 1), (2, 1), (3, 1), (4, 0), (5, 1), (5, 1)]
    assert ledger.pending(ledger.addressed(more), [1, 2]).filter(F.size("missing") > 0).isEmpty()


def test_random_spans_against_re(spark):
    import random

    r = random.Random(5)
    parts = ["token", "=", ":", " ", "'", "secret", "abcdef", "AKIA", "ABCDEFGHIJKLMNOPQRST", "0123456789abcdef" * 2, "é", "\n", "𝄞", "xy", "api_key"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 60))) for _ in range(400)]
    rules = [(rule, re.compile(rule.pattern)) for rule in BASE_RULES]
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, text string").select("n", secret_ledger.all_spans(F.col("text"), BASE_RULES).alias("s")).collect()
    for row in rows:
        wanted = [(m.start(), m.end(), rule.kind) for rule, p in rules for m in p.finditer(texts[row.n]) if len(m.group(rule.group)) >= rule.least]
        assert [(s.start, s.end, s.kind) for s in row.s] == wanted
