"""Fingerprints and likeness against plain Python, and runs of unevenly spread ids."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from citemill.llm import multiset_hash
from citemill.llm.common import written

MASK = (1 << 62) - 1


def paragraphs_of(text):
    return [p for p in re.split(multiset_hash.PARAGRAPH_END, text or "") if p.strip(" ")]


@pytest.fixture(scope="module")
def hashes(spark, documents):
    """xxhash64(paragraph, 0..3) of every paragraph, from Spark, one row each."""
    found = sorted({p for r in documents.values() for p in paragraphs_of(r.text)} | {"one", "two", "three"})
    rows = spark.createDataFrame([(p,) for p in found], "p string").select("p", *[F.xxhash64("p", F.lit(n)).alias(f"h{n}") for n in range(4)]).collect()
    return {r.p: r[1:] for r in rows}


def test_fingerprint_is_the_sum_of_lanes(spark, documents, hashes):
    """The string, lane by lane, and the likeness by the cosine of signed bits."""
    docs = spark.createDataFrame([(i, r.text) for i, r in documents.items()], "doc_id long, text string")
    found = {r.doc_id: r for r in multiset_hash.with_next(docs).select("doc_id", "text", "next_text", multiset_hash.as_string("vector").alias("f")).collect()}
    assert found.keys() == documents.keys()
    for r in found.values():
        parts = [hashes[p] for p in paragraphs_of(r.text)]
        wide = [sum(h[n] & MASK for h in parts) & MASK for n in range(4)]
        assert r.f[: 8 + 64] == f"{len(parts):08X}" + "".join(f"{w:016X}" for w in wide)
        packed = [int(r.f[72 + 16 * n : 88 + 16 * n], 16) for n in range(multiset_hash.PACKED)]
        for n, value in enumerate(packed):
            for half in (0, 1):
                bit = n % 32 + 32 * half
                assert value >> (32 * half) & (1 << 30) - 1 == sum(h[n // 32] >> bit & 1 for h in parts)


def test_likeness_follows_the_shared_paragraphs(spark):
    """Against the exact cosine of the multisets: within five deviations of the estimate."""
    r = np.random.default_rng(4)
    rows = []
    for n in range(60):
        shared = [f"shared {n} {k}." for k in range(r.integers(0, 30))]
        a, b = (shared + [f"{side} {n} {k}." for k in range(r.integers(1, 20))] for side in "ab")
        rows.append((" ".join(a), " ".join(r.permutation(b)), len(shared) / (len(a) * len(b)) ** 0.5))
    table = spark.createDataFrame(rows, "a string, b string, exact double")
    table = written(table.select("exact", *[multiset_hash.multiset_sum(c).alias(c) for c in "ab"]), "test")
    table = table.select("*", *[multiset_hash.lanes(c).alias(f"l{c}") for c in "ab"])
    off = [abs(x.near - x.exact) for x in table.select("exact", multiset_hash.likeness("a", "b", "la", "lb").alias("near")).collect()]
    assert max(off) < 5 * 0.09 and np.mean(off) < 0.09


@pytest.mark.parametrize("kind", ["long", "string"])
def test_dense_ids_with_outliers(spark, kind):
    """Clusters, outliers, a hot id, null ids: no run has many more rows than wished, and neighbours are found."""
    dense = spark.range(30_000).select((F.col("id") + 10**12).alias("doc_id"), F.concat(F.lit("d"), "id").alias("text"))
    hot = spark.range(6_000).select(F.lit(77).cast("long"), F.concat(F.lit("h"), "id"))
    none = spark.range(6_000).select(F.lit(None).cast("long"), F.concat(F.lit("n"), "id"))
    far = spark.range(50).select(F.col("id") * 10**16 - 10**17, F.concat(F.lit("f"), "id"))
    docs = dense.union(hot).union(none).union(far).withColumn("doc_id", F.col("doc_id").cast(kind))
    runs = multiset_hash.with_runs(docs).groupBy("run").agg(F.count("*").alias("rows")).collect()
    assert max(r.rows for r in runs) <= (multiset_hash.RUN_LIMIT + 1) * multiset_hash.RUN_ROWS
    rows = multiset_hash.with_next(docs).select("doc_id", "text", "next_text").collect()
    assert len(rows) == 42_050
    key = spark.createDataFrame([(r.text,) for r in rows], "text string").select("text", F.xxhash64("text").alias("h")).collect()
    hashed = {r.text: r.h for r in key}
    order = sorted(rows, key=lambda r: (r.doc_id is None, r.doc_id.encode() if kind == "string" and r.doc_id else r.doc_id or 0, hashed[r.text]))
    assert all(a.next_text == b.text for a, b in zip(order, order[1:] + order[:1]))
