"""Hard negatives against all pairs in plain Python."""

from __future__ import annotations

import math
import random

import pytest

from citemill.llm import hard_negatives
from citemill.llm.hard_negatives import Mining

SCHEMA = "vec_id long, label int, embedding array<double>, cell int, score long"


def by_all_pairs(rows, m=Mining()):
    table = set()
    for i, label, x, *_ in rows:
        if label is None or x is None or any(v is None or not math.isfinite(v) for v in x):
            continue
        table.add((i, (label + 1) % m.labels if i is not None and i % m.relabel_every == 0 else label, tuple(math.floor(256 * v) for v in x)))
    found = []
    last = lambda s: (-s[1], s[0] is None, s[0] or 0)
    for i, label, x in table:
        if i is None or i % m.every:
            continue
        scores = [(j, sum(a * b for a, b in zip(x, y)), other == label) for j, other, y in table if j != i]
        for p in sorted((s for s in scores if s[2]), key=last)[: m.positives]:
            inside = sorted((s for s in scores if not s[2] and m.low * p[1] <= m.of * s[1] <= m.high * p[1]), key=last)
            found += [(i, p[0], rank, n[0], p[1], n[1]) for rank, n in enumerate(inside[: m.negatives], 1)]
    return sorted(found, key=repr)


def mined(spark, rows, **sizes):
    return sorted((tuple(r) for r in hard_negatives.mine(spark.createDataFrame(rows, SCHEMA), **sizes).collect()), key=repr)


@pytest.mark.parametrize("sizes", [{}, {"pivots": 9, "group": 2, "lot_rows": 120}])
def test_random_and_clustered_rows(spark, sizes):
    r = random.Random(4)
    centres = [[r.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    rows = [(i, r.randrange(4), [r.gauss(0, 0.2) for _ in range(6)], 1, 2) for i in range(0, 300)]
    rows += [(i, r.randrange(6), [c + r.gauss(0, 0.05) for c in r.choice(centres)], 1, 2) for i in range(300, 600)]
    wanted = by_all_pairs(rows)
    assert len(wanted) > 50 and mined(spark, rows, **sizes) == wanted


def test_bounds_leave_rows_out(spark):
    """Groups far from each other don't get each other's rows."""
    r = random.Random(8)
    rows = [(i, i % 3, [(5.0 if i % 2 else -5.0) + r.gauss(0, 0.01), r.gauss(0, 0.01)], 1, 2) for i in range(400)]
    table = hard_negatives.written(hard_negatives.prepared(spark.createDataFrame(rows, SCHEMA)), "test")
    space = hard_negatives.space_of(table, 4, 4)
    placed = hard_negatives.written(space.placed(table), "test")
    anchors = space.placed(table.filter("vec_id % 100 = 0"), anchors=True)
    groups = hard_negatives.dealt(anchors, 100).groupBy("group", "cell").agg({"dist": "max"}).toDF("group", "cell", "radius").selectExpr("*", "600D as reach", "0D as nearest")
    assert 0 < hard_negatives.served(placed, groups, space).count() < 400 * groups.count()


def test_ties_repeats_and_rows_that_take_no_part(spark):
    r = random.Random(6)
    rows = [(i, i % 2, [float(r.randrange(3)) for _ in range(2)], 1, 2) for i in range(1, 230)]
    rows += rows[95:105] + [(100, 1, [1.0, 2.0], 9, 9), (100, 0, [2.0, 2.0], 9, 9)]
    rows += [(None, 0, [2.0, 1.0], 1, 1), (None, 1, [1.0, 1.0], 1, 1), (300, None, [1.0, 1.0], 1, 1), (400, 1, None, 1, 1), (500, 1, [None, 1.0], 1, 1)]
    rows += [(600, 1, [float("nan"), 1.0], 1, 1), (700, 0, [float("inf"), 1.0], 1, 1), (800, 1, [], 1, 1), (900, 0, [2.0], 1, 1), (1000, 0, [-1.0, -1.0], None, None)]
    once = mined(spark, rows, pivots=3, group=1, lot_rows=50)
    # Two rows have the id 100, so compare row by row: both are anchors.
    assert once == by_all_pairs(rows)


def test_whole_numbers_beyond_exact_floats(spark):
    r = random.Random(7)
    rows = [(i, r.randrange(3), [r.uniform(0, 900_000) for _ in range(4)], 1, 2) for i in range(250)] + [(1100, 0, [1e300, 0.0, 0.0, 0.0], 1, 2)]
    assert mined(spark, rows) == by_all_pairs(rows[:-1])


def test_empty_tables_and_single_labels(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(0, 1, [1.0], 1, 1)]) == []
    assert mined(spark, [(i * 3 + 100, 1, [1.0], 1, 1) for i in range(5)]) == []
