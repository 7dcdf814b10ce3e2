"""Shards of repeated rows, and slots in the order of the keys at several sizes."""

import pytest
from pyspark.sql import functions as F

from citemill.llm import histogram_shards
from citemill.llm.common import written


def test_repeated_rows_are_split(spark):
    """Of 20,000 rows 6,000 repeat one id and text, 4,000 one text."""
    rows = spark.range(10_000).select("id", F.concat(F.lit("text "), "id").alias("text"))
    rows = rows.union(spark.range(6000).select(F.lit(7).cast("long"), F.lit("the same row"))).union(spark.range(4000).select(F.col("id") + 50_000, F.lit("the same text")))
    placed = written(histogram_shards.shard_by_bytes(rows.withColumnRenamed("id", "doc_id")), "placed")
    shards = placed.groupBy("shard").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"), F.min("slot").alias("low"), F.max("slot").alias("high"), F.countDistinct("slot").alias("slots")).collect()
    mean = sum(r.bytes for r in shards) / histogram_shards.SHARDS
    assert len(shards) == histogram_shards.SHARDS
    assert max(r.bytes for r in shards) <= (1 + 2 * histogram_shards.GROUP_TOLERANCE) * mean
    assert all((r.low, r.high, r.slots) == (0, r.rows - 1, r.rows) for r in shards)


@pytest.mark.parametrize("n", [500, 60_000, 1_000_000])
def test_slots_are_in_key_order(spark, n):
    rows = spark.range(n).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("t"), "id")).alias("text"))
    placed = histogram_shards.shard_by_bytes(rows)
    keys = histogram_shards.sized(rows).select("doc_id", F.concat(*[F.lpad(F.hex(c), 16, "0") for c in ("text_key", "id_key")]).alias("key"))
    both = written(placed.join(keys, "doc_id"), "both")
    whole = both.repartition(1).sortWithinPartitions("shard", "slot").select("key", (F.col("shard") * (1 << 40) + F.col("slot")).alias("at"))
    assert both.count() == n
    keys = [r.key for r in whole.toLocalIterator()]
    assert keys == sorted(keys)


def test_crowded_lots_get_longer_prefixes(spark):
    rows = written(histogram_shards.sized(spark.range(40_000).select(F.lit(1).alias("doc_id"), F.lit("x").alias("text"))), "sized")
    assert histogram_shards.with_lots(rows, 20).groupBy("lot").count().agg(F.max("count")).first()[0] <= histogram_shards.LOT_LIMIT * histogram_shards.SLOT_ROWS
