"""Texts of very many paragraphs."""

from __future__ import annotations

from citemill.llm import multiset_hash
from citemill.llm.common import written


def test_disjoint_long_texts_are_not_alike(spark):
    texts = {n: "".join(f"{n}{i}.\n" for i in range(40_000)) for n in "ab"} | {"c": "same.\n" * 40_000}
    table = spark.createDataFrame(list(texts.items()), "name string, text string")
    table = written(table.withColumn("v", multiset_hash.multiset_sum("text")), "test").withColumn("l", multiset_hash.lanes("v"))
    a, b = (table.filter(f"name = '{n}'").selectExpr(f"v as {n}", f"l as {n}_lanes") for n in "ab")
    assert a.join(b).select(multiset_hash.likeness("a", "b", "a_lanes", "b_lanes").alias("near")).first().near < 0.5
    assert {abs(x) for x in table.filter("name = 'c'").first().l} == {40_000}
