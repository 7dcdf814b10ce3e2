"""What each of several filters removes, alone and in every order, and its Shapley share, by a multilinear polynomial.

A document's mask says which of n filters it fails. With c(m) documents of mask m, the documents that a random set of
filters removes, filter i being in it with probability x_i, are on average
    f(x) = sum over m of c(m) (1 - product over i in m of (1 - x_i)),
a polynomial without squares: its term T (a set of filters) has the coefficient (-1)^(|T|+1) times the documents that fail
all of T. At a corner, x_i being 1 for the filters that have run and else 0, f counts the removed documents exactly; along the diagonal
the integral of its derivative by x_i, the sum of coefficient / |T| over the terms with i, is filter i's Shapley value. Times
n! that is a whole number: what the filter removes summed over all orders.

So the table is read once, masks are counted with partial sums (at most 2^n rows a part and task), and everything else works on
31 terms a part. Rows that share a text meet by its SHA-256; only groups of several rows are joined back, hot ones by
broadcast.

Defined results: null texts count as empty, and empty texts fail A alone (and E if repeated); a null doc_id fails no E and makes
no other row fail it; rows that repeat doc_id and text don't fail E by each other; a null lang is the part "", like an empty
one; a document is good or toxic if any row of labels for its doc_id says so; an empty table gives no rows; further columns
change nothing.
"""

from __future__ import annotations

from fractions import Fraction
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citemill.llm.common import SPACE, attach, read_table, text_or_empty, written

FILTERS = "ABCDE"
MEASURES = ("removed", "good", "toxic")


def quality_failures(text: Column) -> list[Column]:
    """Conditions A to D of a text without nulls: few words, repeated words, capitals, marks."""
    words = F.array_remove(F.split(text, f"[{SPACE}]+"), "")
    n = F.size(words)
    return [n < 100, F.size(F.array_distinct(words)) * 100 < n * 80, F.regexp_count(text, F.lit("[A-Z]")) * 100 > F.length(text) * 10, F.rlike(text, F.lit("[#$%&*|]"))]


def failure_masks(docs: DataFrame, part: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, part and mask of every document: bit i is set if it fails filter i of FILTERS, the last being that a smaller
    doc_id has the same text."""
    text = text_or_empty(text_col)
    bits = [F.when(c, F.lit(1 << i)).otherwise(0) for i, c in enumerate(quality_failures(text))]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(part), F.lit("")).alias("part"), F.sha2(text, 256).alias("digest"), sum(bits[1:], bits[0]).alias("mask"))
    rows = written(rows, "audit-rows")
    groups = written(rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("members")).filter("members > 1"), "audit-groups")
    is_copy = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    copies = F.when(is_copy, F.lit(1 << (len(FILTERS) - 1))).otherwise(0)
    return attach(rows, groups, "digest", "members", rows.count()).select("doc_id", "part", (F.col("mask") + copies).alias("mask"))


def with_labels(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """masks with good and toxic, 0 or 1."""
    flags = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    flag = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return masks.join(flags, "doc_id", "left").select("part", "mask", flag("good"), flag("toxic"))


def removal_terms(masks: DataFrame, filters: str = FILTERS) -> DataFrame:
    """part, total (documents) and terms, the coefficients of the part's removal polynomials: term (a set of filters as a mask),
    and one number for each of MEASURES."""
    counts = masks.groupBy("part", "mask").agg(F.count("*").alias("removed"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    inside = F.filter(F.sequence(F.lit(0), F.lit((1 << len(filters)) - 1)), lambda t: t.bitwiseAND(F.col("mask")) == t)
    subsets = counts.select("part", F.explode(inside).alias("term"), *MEASURES)
    sign = F.when(F.bit_count("term") % 2 == 1, 1).otherwise(-1)
    sums = subsets.groupBy("part", "term").agg(*[(F.sum(m) * sign).cast("bigint").alias(m) for m in MEASURES])
    # The empty set is no term; its sum counts all documents.
    total = F.sum(F.when(F.col("term") == 0, -F.col("removed"))).alias("total")
    return sums.groupBy("part").agg(total, F.collect_list(F.when(F.col("term") > 0, F.struct("term", *MEASURES))).alias("terms"))


def _sum(terms: Column, value) -> Column:
    return F.aggregate(terms, F.lit(0).cast("bigint"), lambda total, t: total + value(t))


def corner(measure: str, ran: Column) -> Column:
    """The polynomial where exactly the filters of a mask have run: documents removed by any of them."""
    return _sum(F.filter("terms", lambda t: t["term"].bitwiseAND(ran) == t["term"]), lambda t: t[measure])


def shapley(bit: Column, filters: str = FILTERS) -> Column:
    """The integral of the derivative by one filter along the diagonal, times the number of orders."""
    shares = [Fraction(factorial(len(filters)), size) for size in range(1, len(filters) + 1)]
    weights = F.array(*[F.lit(int(s)).cast("bigint") for s in shares])  # n! / |T| is whole for every size
    return _sum(F.filter("terms", lambda t: t["term"].bitwiseAND(bit) != 0), lambda t: t["removed"] * F.element_at(weights, F.bit_count(t["term"]).cast("int")))


def audit(masks: DataFrame, filters: str = FILTERS) -> DataFrame:
    """masks (part, mask, good, toxic) -> a row for each part, order of the filters and step."""
    orders = F.array(*[F.lit("".join(p)) for p in permutations(filters)])
    rows = removal_terms(masks, filters).select("*", F.explode(orders).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(filters)))).alias("step"))
    place = {f: F.instr(F.col("filter_order"), f) for f in filters}
    before = sum((F.when(p < F.col("step"), 1 << i).otherwise(0) for i, p in enumerate(place.values())), F.lit(0))
    bit = sum((F.when(p == F.col("step"), 1 << i).otherwise(0) for i, p in enumerate(place.values())), F.lit(0))
    rows = rows.withColumns({"before": before, "bit": bit}).withColumn("after", F.col("before") + F.col("bit"))
    everyone = F.lit((1 << len(filters)) - 1)
    gone = {m: corner(m, F.col("after")) - corner(m, F.col("before")) for m in MEASURES}
    unique = corner("removed", everyone) - corner("removed", everyone - F.col("bit"))
    return rows.select(
        "part", "filter_order", "step", (F.col("total") - corner("removed", F.col("after"))).alias("kept"), gone["removed"].alias("removed"), (corner("removed", F.col("bit")) - gone["removed"]).alias("redundant"),
        unique.alias("unique_fails"), gone["good"].alias("good_lost"), gone["toxic"].alias("toxic_lost"), shapley(F.col("bit"), filters).alias("shapley"),
    )


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    masks = failure_masks(read_table(spark, sf_dir, "documents"))
    return audit(with_labels(masks, read_table(spark, sf_dir, "labels")))
