"""Exact quantiles against sorting, and the trigram index against ILIKE."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from citemill.operators import text_index
from citemill.operators.quantiles import exact_percentiles

SHARES = (0.0, 0.2, 0.25, 0.5, 0.999, 1.0)


def test_quantiles_of_several_columns(spark, rows):
    r = random.Random(1)
    data = [(r.randrange(9), r.gauss(0, 1) * 10 ** r.randrange(-9, 9), r.choice((None, 5.0)), None, r.choice((-1.7e308, 1.7e308, float("nan"), 0.0))) for _ in range(3001)]
    names = ["few", "wide", "gaps", "none", "far"]
    found = exact_percentiles(rows("few long, wide double, gaps double, none double, far double", *data), names, SHARES)
    for i, name in enumerate(names):
        values = [float(d[i]) for d in data if d[i] is not None and d[i] == d[i]]
        if not values:
            assert found[name] is None
        elif name == "far":
            assert found[name][0] == -1.7e308 and found[name][-1] == 1.7e308
        else:
            assert found[name] == pytest.approx(np.quantile(values, SHARES).tolist(), rel=1e-12)


def test_quantiles_equal_sparks_on_many_values(spark):
    table = spark.range(200_000).select((F.exp(F.rand(3) * 50)).alias("x"))
    wanted = table.agg(F.percentile("x", F.array(*map(F.lit, SHARES)))).first()[0]
    assert exact_percentiles(table, ["x"], SHARES)["x"] == pytest.approx(wanted, rel=1e-12)
    assert exact_percentiles(table.limit(0), ["x"], SHARES) == {"x": None}


TEXTS = ["Deep learning", "deep  LEARNING of things", "ab", "", None, "100% of it", "a_b", "ÄÖÜ straße", "x" * 5000 + "needle", "Learn", "aaa", "aaaa", "line\nbreak"]


@pytest.mark.parametrize("pattern", ["%learn%", "%deep%ing", "%d__p%l%", "%ab%", "%a%", "%%", "%100\\%%", "%a\\_b%", "%öü s%", "%needle", "nothing%here", "%aaa%", "%e\nb%", "_b"])
def test_patterns(spark, rows, tmp_path_factory, pattern):
    texts = rows("id long, text string", *enumerate(TEXTS))
    root = str(tmp_path_factory.mktemp("index"))
    index = text_index.TrigramIndex(spark, root)
    for part in range(2):
        index.append(texts.filter(F.col("id") % 2 == part))
    wanted = sorted(r.id for r in texts.filter(F.ilike("text", F.lit(pattern))).collect())
    assert sorted(r.id for r in index.search(pattern).collect()) == wanted


def test_a_search_reads_its_grams_alone(spark, tmp_path):
    index = text_index.TrigramIndex(spark, str(tmp_path))
    index.append(spark.range(3000).select("id", F.concat(F.lit("title number "), F.col("id").cast("string")).alias("text")))
    found = index.candidates("%2718%")
    assert "PushedFilters: [In(gram" in found._jdf.queryExecution().toString()
    assert [r.id for r in found.collect()] == [2718]
