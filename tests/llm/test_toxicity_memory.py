"""What training holds of the driver's memory."""

import tracemalloc

from pyspark.sql import functions as F

from citemill.llm import toxicity


def test_training_holds_word_numbers_and_a_few_texts(spark):
    words = F.expr("concat_ws(' ', transform(sequence(1, 300), n -> concat('w', pmod(xxhash64(id, n), 120000))))")
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), words.alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic"))
    tracemalloc.start()
    try:
        assert toxicity.fit(docs, labels, epochs=1)
        peak = tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()
    print(f"peak {peak:.0f} MB")
    assert peak < 65
