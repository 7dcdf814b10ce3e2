"""Exact quantiles of many columns without sorting: distributed selection by refining histograms.

For each rank that is asked for, a range of values holds it. A round counts the values of each range in BINS bins, with
partial sums, in one pass over the table for all columns and ranks; the bin that holds the rank becomes the range, cut to
the least and greatest value in it. The driver reads at most BINS counts a rank and round.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil, floor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS = 1024


def exact_percentiles(rows: DataFrame, columns: Sequence[str], shares: Sequence[float]) -> dict[str, list[float] | None]:
    """For each column its quantiles by linear interpolation; None without values. Nulls and NaN are left out."""
    pairs = F.array(*[F.struct(F.lit(i).alias("column"), F.col(c).cast("double").alias("x")) for i, c in enumerate(columns)])
    values = rows.select(F.explode(pairs).alias("v")).select("v.*").filter("x is not null and not isnan(x)")
    found = {r["column"]: r for r in values.groupBy("column").agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).collect()}
    # rank -> (low, high, values below low) of the range that holds it, for each column.
    ranges = {i: {k: (r.low, r.high, 0) for q in shares for k in {floor(q * (r.n - 1)), ceil(q * (r.n - 1))}} for i, r in found.items()}
    while open_ := {(i, x) for i, ranks in ranges.items() for x in ranks.values() if x[0] < x[1]}:
        counts = _counted(values, sorted(open_))
        for i, ranks in ranges.items():
            for k, x in ranks.items():
                if (i, x) in open_:
                    ranks[k] = _narrowed(counts[i, x], k, x[2])
    return {c: [_between(ranges[i], q * (found[i].n - 1)) for q in shares] if i in found else None for i, c in enumerate(columns)}


def _counted(values: DataFrame, ranges: list[tuple[int, tuple]]) -> dict[tuple, list]:
    """For each range its bins (n, low, high), ascending."""
    listed = F.array(*[F.struct(F.lit(n).alias("range"), F.lit(i).alias("of"), F.lit(low).alias("low"), F.lit(high).alias("high")) for n, (i, (low, high, _)) in enumerate(ranges)])
    inside = F.filter(listed, lambda r: (r["of"] == F.col("column")) & (F.col("x") >= r["low"]) & (F.col("x") <= r["high"]))
    rows = values.select("x", F.explode(inside).alias("r"))
    # Halves, as the difference of two doubles may be infinite. Every step keeps the order of x, so bins are in order too.
    place = (F.col("x") / 2 - F.col("r.low") / 2) / (F.col("r.high") / 2 - F.col("r.low") / 2) * (BINS - 1)
    bins = rows.groupBy("r.range", F.floor(place).alias("bin")).agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
    found: dict[tuple, list] = {r: [] for r in ranges}
    for r in sorted(bins.collect(), key=lambda r: (r["range"], r["bin"])):
        found[ranges[r["range"]]].append((r.n, r.low, r.high))
    return found


def _narrowed(bins: list, rank: int, below: int) -> tuple[float, float, int]:
    for n, low, high in bins:
        if rank < below + n:
            return low, high, below
        below += n
    raise AssertionError("a range holds its rank")


def _between(ranks: dict[int, tuple], rank: float) -> float:
    low, high = ranks[floor(rank)][0], ranks[ceil(rank)][0]
    return low + (rank - floor(rank)) * (high - low) if high != low else low
