"""An index of trigrams for searches by substring: what LIKE '%...%' finds without reading every text.

Each batch adds postings (gram, id), sorted by gram in files of ranges, so that a search reads the row groups of its grams alone;
the number of postings of each gram; and its texts, sorted by id. A search takes the rarest grams of its pattern, intersects
their postings, and decides by the pattern itself on the texts that are left. A pattern without three letters in a row takes the
grams that hold its letters.

Defined results: null texts are found by nothing; texts of fewer than three letters are a gram themselves; an id may have several
texts (of several batches), each of which is found on its own; a pattern without letters finds every text that it fits.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Grams of a search whose postings are read.
RAREST = 4
#: Ids up to which they are looked up by value, so that the scan of texts can skip row groups.
LOOKED_UP = 1000


def grams(text: Column) -> Column:
    """The distinct runs of three letters of a text in lower case."""
    lower = F.lower(text)
    return F.when(F.length(lower) < 3, F.array(lower)).otherwise(F.array_distinct(F.regexp_extract_all(lower, F.lit("(?s)(?=(...))"), F.lit(1))))


def pieces(pattern: str) -> list[str]:
    """The runs of letters of a LIKE pattern between its wildcards, in lower case."""
    found = [""]
    for escaped, c in re.findall(r"(?s)(\\?)(.)", pattern.lower()):
        if c in "%_" and not escaped:
            found.append("")
        else:
            found[-1] += c
    return [p for p in found if p]


class TrigramIndex:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def append(self, rows: DataFrame, id_col: str = "id", text_col: str = "text") -> None:
        part = f"part={uuid.uuid4().hex}"
        texts = f"{self.root}/texts/{part}"
        rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text is not null").repartitionByRange("id").sortWithinPartitions("id").write.parquet(texts)
        postings = self.spark.read.parquet(texts).select(F.explode(grams(F.col("text"))).alias("gram"), "id").distinct()
        # A gram in very many texts spans several ranges: they are cut by id as well.
        postings.repartitionByRange("gram", "id").sortWithinPartitions("gram", "id").write.option("parquet.block.size", 4 << 20).parquet(f"{self.root}/postings/{part}")
        self.spark.read.parquet(f"{self.root}/postings/{part}").groupBy("gram").count().repartitionByRange("gram").sortWithinPartitions("gram").write.parquet(f"{self.root}/counts/{part}")

    def candidates(self, pattern: str) -> DataFrame | None:
        """Ids of the texts that may fit; None: all may."""
        whole = sorted({p[i : i + 3] for p in pieces(pattern) for i in range(len(p) - 2)})
        postings = self.spark.read.parquet(f"{self.root}/postings")
        if whole:
            counts = self.spark.read.parquet(f"{self.root}/counts").filter(F.col("gram").isin(whole)).groupBy("gram").agg(F.sum("count").alias("n"))
            known = {r.gram: r.n for r in counts.collect()}  # a row for each gram of the pattern
            rarest = sorted(whole, key=lambda g: known.get(g, 0))[:RAREST]
            found = postings.filter(F.col("gram").isin(rarest)).select("gram", "id").distinct()
            return found.groupBy("id").agg(F.count("*").alias("n")).filter(F.col("n") == len(rarest)).select("id")
        if not pieces(pattern):
            return None
        longest = max(pieces(pattern), key=len)
        return postings.filter(F.contains("gram", F.lit(longest))).select("id").distinct()

    def search(self, pattern: str) -> DataFrame:
        """(id, text) of the texts that fit the LIKE pattern, whatever the case."""
        texts = self.spark.read.parquet(f"{self.root}/texts").select("id", "text")
        found = self.candidates(pattern)
        if found is not None:
            few = [r.id for r in found.limit(LOOKED_UP + 1).collect()]
            texts = texts.filter(F.col("id").isin(few)) if len(few) <= LOOKED_UP else texts.join(found, "id", "left_semi")
        return texts.filter(F.ilike("text", F.lit(pattern)))
