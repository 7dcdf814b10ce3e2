"""Leak-free stratified splits of samples that share papers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citemill.operators.graph import components
from citemill.operators.quantiles import exact_percentiles
from citemill.sources.storage import numbered, numbered_in

TIERS = ["low", "medium", "high", "very_high", "landmark"]


def clusters(samples: DataFrame) -> DataFrame:
    """samples (sample, chain) -> sample and cluster: samples that share any paper of their chains, directly or through
    others, are in one cluster; numbered from 0 in the order of their smallest sample."""
    pairs = samples.select(F.concat(F.lit("s:"), F.lpad(F.col("sample").cast("string"), 20, "0")).alias("src"), F.explode_outer("chain").alias("paper"))
    vertices = pairs.select(F.col("src").alias("id")).union(pairs.filter("paper is not null").select(F.concat(F.lit("t:"), "paper"))).distinct()
    edges = pairs.filter("paper is not null").select("src", F.concat(F.lit("t:"), "paper").alias("dst")).distinct()
    labels = components(vertices, edges).filter("id like 's:%'")
    # Sample ids sort before papers, so a component's smallest id is its smallest sample.
    numbers = numbered(labels.select("component").distinct(), "component", "cluster")
    return labels.join(numbers, "component").select(F.substring("id", 3, 20).cast("bigint").alias("sample"), "cluster")


def tier_bounds(samples: DataFrame, column: str = "citation_count") -> list[float]:
    """The quantiles 0.2, 0.4, 0.6, 0.8 by linear interpolation; empty without values."""
    return exact_percentiles(samples, [column], (0.2, 0.4, 0.6, 0.8))[column] or []


def tier_column(value: Column, bounds: list[float]) -> Column:
    """Right-closed bins; a bound that doesn't exceed the one before it makes no bin, and its label is skipped. No
    bounds: unknown; a missing value: null."""
    if not bounds:
        return F.lit("unknown")
    last, found = -1.0, F.lit(None).cast("string")
    kept = []
    for bound, label in zip([*bounds, float("inf")], TIERS):
        if bound > last:
            kept.append((bound, label))
            last = bound
    for bound, label in reversed(kept):
        found = F.when(value <= F.lit(float(bound)), label).otherwise(found)
    return F.when(value.isNotNull() & (value >= -1), found)


def most_frequent(rows: DataFrame, by: str, column: str, order: Column | None = None) -> DataFrame:
    """by and the most frequent value of column; ties go to the smallest by order, or by value."""
    counts = rows.filter(F.col(column).isNotNull()).groupBy(by, column).agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), order if order is not None else F.col(column)))
    return counts.withColumn("_place", place).filter("_place = 1").select(by, column)


def cluster_profiles(samples: DataFrame) -> DataFrame:
    """samples (cluster, year, field, tier) -> cluster, cluster_size, cluster_max_year, cluster_field, cluster_tier."""
    sizes = samples.groupBy("cluster").agg(F.count("*").alias("cluster_size"), F.max("year").alias("cluster_max_year"))
    rank = F.array_position(F.array(*map(F.lit, TIERS)), F.col("tier"))
    fields = most_frequent(samples, "cluster", "field").withColumnRenamed("field", "cluster_field")
    tiers = most_frequent(samples, "cluster", "tier", rank).withColumnRenamed("tier", "cluster_tier")
    return sizes.join(fields, "cluster", "left").join(tiers, "cluster", "left")


def assign_splits(profiles: DataFrame, train: float = 0.8, val: float = 0.1, seed: int = 42) -> DataFrame:
    """profiles with stratum and split. In each stratum (field and tier), by maximal year: one cluster trains; of two
    the second tests; otherwise quotas with half-even rounding, at least one each, by place after a shuffle inside
    blocks of a third."""
    stratum = F.concat_ws("_", "cluster_field", "cluster_tier")
    rows = profiles.withColumn("stratum", stratum)
    sizes = rows.groupBy("stratum").agg(F.count("*").alias("n"))
    # Lots: a year's clusters, then blocks of the shuffle cut by the first digits of its hash.
    rows = numbered_in(rows.join(sizes, "stratum"), "stratum", "cluster_max_year", ["cluster"], "_i")
    block = F.floor(F.col("_i") / F.greatest(F.floor(F.col("n") / 3), F.lit(1)))
    shuffled = F.md5(F.concat_ws(":", F.lit(seed), "cluster").cast("binary"))
    rows = rows.withColumns({"_block": block, "_hash": shuffled}).withColumn("_lot", F.concat_ws(":", F.lpad(F.col("_block").cast("string"), 2, "0"), F.substring("_hash", 1, 2)))
    rows = numbered_in(rows, "stratum", "_lot", ["_hash", "cluster"], "_at").withColumn("_at", F.col("_at") + 1)
    n = F.col("n")
    quota = lambda share: F.greatest(F.lit(1), F.bround(n * share).cast("int"))
    n_val = quota(val)
    n_train = F.when(n - quota(train) - n_val <= 0, n - n_val - 1).otherwise(quota(train))
    split = (
        F.when(n == 1, "train").when(n == 2, F.when(F.col("_i") == 0, "train").otherwise("test"))
        .when(F.col("_at") <= n_train, "train").when(F.col("_at") <= n_train + n_val, "val").otherwise("test")
    )
    return rows.withColumn("split", split).drop("n", "_i", "_block", "_at", "_hash", "_lot")


def leakage(rows: DataFrame) -> DataFrame:
    """rows (split, id) -> split_a, split_b and shared, the number of ids in both, for the pairs that share any."""
    ids = rows.select("split", "id").distinct()
    other = ids.toDF("split_b", "id")
    return ids.withColumnRenamed("split", "split_a").join(other, "id").filter("split_a < split_b").groupBy("split_a", "split_b").agg(F.count("*").alias("shared"))
