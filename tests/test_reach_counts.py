"""Counts of descendants by depth, in blocks, against the pairs themselves."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from citemill import registry
from citemill.operators import traverse

RANDOM = [(f"n{a}", f"n{b}") for a, b in random.Random(6).sample([(a, b) for a in range(40) for b in range(40)], 70)]


@pytest.mark.parametrize("block", [10, 1000])
def test_counts_are_those_of_pairs(rows, block):
    edges = rows("from_id string, to_id string", *RANDOM, *RANDOM[:5], ("x", "x"))
    counted = traverse.reach_counts(edges, 4, "backward", block)
    pairs = traverse.reachability(edges, 4, "backward").groupBy("ancestor", "depth", "direction").agg(F.count("*").alias("descendants"))
    assert sorted(map(tuple, counted.collect())) == sorted(map(tuple, pairs.select(counted.columns).collect()))
    assert {r.depth for r in counted.select("depth").distinct().collect()} == {1, 2, 3, 4}


def test_pairs_are_not_written(spark, monkeypatch):
    tables, plain = [], traverse.written
    monkeypatch.setattr(traverse, "written", lambda df, name, *more: (tables.append(df.columns), plain(df, name, *more))[1])
    assert registry.queries()["g08_reachability"](spark, "/root/testdata/sf0.001").count()
    assert tables and not any("descendant" in columns for columns in tables)
