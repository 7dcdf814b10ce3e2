"""Training uses all labelled rows, in shards where they are many."""

import numpy as np
from pyspark.sql import functions as F

from citemill.llm import toxicity


def labelled(spark, n):
    """Texts of 20 words, one of which tells a toxic one; each such word stands in few texts, spread over all."""
    word = F.expr("concat(if(id % 4 = 0, 'bad', 'fine'), pmod(xxhash64(id), 40))")
    rest = F.expr("concat_ws(' ', transform(sequence(1, 19), n -> concat('w', pmod(xxhash64(id, n), 3000))))")
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat_ws(" ", rest, word).alias("text"))
    return docs, docs.select("doc_id", (F.col("doc_id") % 4 == 0).cast("int").alias("toxic"))


def test_no_labelled_row_is_left_out(spark):
    docs, labels = labelled(spark, 16_000)
    known = labels.filter(~toxicity.is_held_out(F.col("doc_id")))
    assert toxicity.sample(docs, labels).count() == known.count() > 10_000


def test_shards_learn_together(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SHARD", 400)
    trained, train = [], toxicity._trained_in_shards
    monkeypatch.setattr(toxicity, "_trained_in_shards", lambda rows, shards, epochs: (trained.append((rows.count(), shards)), train(rows, shards, epochs))[1])
    docs, labels = labelled(spark, 2400)
    network = toxicity.fit(docs, labels)
    n = labels.filter(~toxicity.is_held_out(F.col("doc_id"))).count()
    assert trained == [(n, -(-n // 400))] and n > 1500
    scored = toxicity.score(docs, network).join(labels, "doc_id").filter(toxicity.is_held_out(F.col("doc_id"))).collect()
    right = np.mean([(r.score >= toxicity.CUT) == r.toxic for r in scored])
    assert right > 0.97, right
    # The same rows in another order and other partitions give the same network but for rounding.
    again = toxicity.fit(docs.orderBy(F.xxhash64("doc_id", F.lit(1))).repartition(3), labels)
    assert np.allclose(network.table, again.table, atol=1e-4) and np.allclose(network.thresholds, again.thresholds, atol=1e-3)


def test_one_kind_of_label_in_shards(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SHARD", 10)
    docs, labels = labelled(spark, 60)
    assert toxicity.fit(docs, labels.withColumn("toxic", F.lit(0))) is None
