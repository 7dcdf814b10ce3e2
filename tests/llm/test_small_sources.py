"""Mixing where a block of words is larger than whole sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from citemill.llm import mixing


def test_tiny_source_beside_a_very_large_one(spark):
    large = spark.range(1000).select("id", F.expr("repeat('w ', 9000)").alias("text"), F.lit("a").alias("source"))
    tiny = spark.range(1000, 1010).select("id", F.lit("two words").alias("text"), F.lit("b").alias("source"))
    docs = large.union(tiny).withColumnRenamed("id", "doc_id")
    rows = mixing.mix(docs).filter("source = 'b'").collect()
    assert sorted(r.doc_id for r in rows) == list(range(1000, 1010))
    assert all(r._mix_times == 3 and len(r._mix_shards) == 3 for r in rows)
    # A target of 9 of its 20 words: four documents of two words and half of one hold them.
    rows = mixing.mix(docs, weights=(1_000_000, 1)).filter("source = 'b'").collect()
    assert 8 <= rows[0]._mix_target <= 10 and abs(sum(sum(r._mix_words) for r in rows) - rows[0]._mix_target) <= 1


def words_taken(rows):
    """source -> (target, source size, words taken)"""
    taken = F.expr("aggregate(_mix_words, 0L, (a, x) -> a + x)")
    return {r.source: r[1:] for r in rows.groupBy("source").agg(F.first("_mix_target"), F.first("_mix_source_size"), F.sum(taken)).collect()}


def test_taken_words_meet_targets(spark):
    """Sources of 1, 2 and a million words, null ids, repeated rows, one giant document."""
    large = spark.range(2000).select("id", F.expr("repeat('w ', 500)").alias("text"), F.lit("a").alias("source"))
    rest = [(1, "one", "b"), (2, "two words", "c"), (None, "x y z", None), (None, "u v", None), (3, "", "d"), (4, None, "d"), (5, "r r r", "e"), (5, "r r r", "e")]
    giant = spark.range(1).select(F.lit(9).cast("long"), F.expr("repeat('g ', 400000)"), F.lit("f"))
    docs = large.union(spark.createDataFrame(rest, "id long, text string, source string")).union(giant).withColumnRenamed("id", "doc_id")
    rows = mixing.mix(docs)
    found = words_taken(rows)
    assert set(found) == {"a", "b", "c", None, "d", "e", "f"}
    for source, (target, size, taken) in found.items():
        assert abs(taken - target) <= 1 and taken <= 3 * size, source
    assert rows.filter("aggregate(_mix_words, 0L, (a, x) -> a + x) > 3 * _mix_size").isEmpty()
    one_each = spark.createDataFrame([(n, "w " * 10000, s) for n, s in enumerate("abc")], "doc_id long, text string, source string")
    assert {s: (round(t), n) for s, (t, _, n) in words_taken(mixing.mix(one_each)).items()} == {"a": (18750, 18750), "b": (7500, 7500), "c": (3750, 3750)}


def test_shards_are_written_in_random_order(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit(" a few words\tin a text ").alias("text"), (F.col("id") % 2).cast("string").alias("source"))
    parts = mixing.drawn(docs).select("doc_id", "text", "_mix_shard", F.spark_partition_id().alias("part")).collect()
    assert len({(r._mix_shard, r.part) for r in parts}) == mixing.OUTPUT_SHARDS
    order = [r.doc_id for r in parts if r._mix_shard == 3]
    assert order != sorted(order) and 0.4 < sum(a < b for a, b in zip(order, order[1:])) / len(order) < 0.6
    cut = [r.text for r in parts if r.text != " a few words\tin a text "]
    assert len(cut) <= 2 and all("a few words\tin a text ".startswith(t) for t in cut)
    total = sum(len(r.text.split()) for r in parts)
    assert total == sum(t[2] for t in words_taken(mixing.mix(docs)).values())


def test_hot_rows_are_spread(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 50)
    same = spark.range(5000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("same old text").alias("text"), F.lit("a").alias("source"))
    docs = same.union(spark.range(500).select("id", F.lit("b c"), F.lit("b")))
    marked = mixing._marked(docs, "doc_id", "text", "source")
    spread, ranges = mixing._spread(marked, mixing._counted(marked))
    assert ranges.agg(F.max("rows")).first()[0] < 200 and spread.count() == 5500
    for target, size, taken in words_taken(mixing.mix(docs)).values():
        assert abs(taken - target) <= 1 and taken <= 3 * size
