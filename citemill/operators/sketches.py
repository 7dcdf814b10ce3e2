"""Distinct counts that add up: a HyperLogLog sketch for each day and value of a dimension, stored once and united over any range."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A sketch has 2^LG_K registers; its relative standard error is below 0.83 / sqrt(2^LG_K), 0.65 % for 14.
LG_K = 14


def relative_error(lg_k: int = LG_K) -> float:
    return 0.83 / 2 ** (lg_k / 2)


def daily_sketches(rows: DataFrame, ts: str, dimension: str, field: str, lg_k: int = LG_K) -> DataFrame:
    """day, dimension, n (rows with a value of field) and sketch, to be stored; a new day is appended."""
    kept = rows.filter(F.col(field).isNotNull())
    return kept.groupBy(F.to_date(ts).alias("day"), F.col(dimension).alias("dimension")).agg(F.count("*").alias("n"), F.hll_sketch_agg(field, F.lit(lg_k)).alias("sketch"))


def distinct_in(sketches: DataFrame, *by: str) -> DataFrame:
    """n (rows, exact) and n_distinct (estimated) of all stored days, or for each value of the columns by; filter sketches for a range. No
    row of data is read."""
    return sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n_distinct"))
