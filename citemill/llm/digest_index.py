"""Exact duplicates with a log-structured merge index over text digests.

append() flushes a memtable for each input task: a run of (digest, doc_id) sorted by digest, with a Parquet Bloom filter in
every file, which point lookups read. compact() merges all runs into one sorted run, with the smallest and the largest
identifier and the number of rows of each digest, and writes a bitmap of the digests that have several rows. resolve()
takes identifiers and group sizes from the compacted run: rows that the bitmap rules out are alone and are
joined with nothing; the others are hits. The texts of hits are compared byte by byte; where a digest has different
texts (a collision), its groups are formed by text.

Defined results: null texts count as empty and equal each other; doc_ids that are null yield to others, and a group
without any keeps null; all rows that repeat the doc_id that stays count as kept (deduplicate() keeps one of them); an
empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citemill.llm.common import attach, new_path, read_table, text_or_empty, written

#: Bits of the bitmap for each digest with several rows, and in all: 64 MB at most. With more such digests than that
#: it lets more rows through, to the same result.
FILTER_BITS, MOST_FILTER_BITS = 16, 1 << 29
RUN_OPTIONS = {"parquet.bloom.filter.enabled#digest": "true", "parquet.bloom.filter.adaptive.enabled": "true"}


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


class DigestIndex:
    """Runs under path: level-0/* from append(), one level-1/* from compact()."""

    def __init__(self, spark: SparkSession, path: str | None = None, digest: Callable[[Column], Column] = sha256):
        self.spark, self.path, self.digest = spark, path or new_path(spark, "digest-index"), digest
        self.runs: list[str] = []
        self.merged: str | None = None
        self.flushes = 0

    def keyed(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        return docs.select(F.col(id_col).alias("doc_id"), self.digest(text_or_empty(text_col)).alias("digest"))

    def append(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Flushes the documents as sorted runs, one for each task; gives them back as (doc_id, digest)."""
        self.flushes += 1
        self.runs.append(f"{self.path}/level-0/{self.flushes}")
        return written(self.keyed(docs, id_col, text_col).sortWithinPartitions("digest", "doc_id"), "run", RUN_OPTIONS, self.runs[-1])

    def entries(self) -> DataFrame:
        """digest, min_id, max_id, rows of all runs, merged or not; a digest can be in several."""
        parts = [self.spark.read.parquet(self.merged)] if self.merged else []
        for run in self.runs:
            one = self.spark.read.parquet(run)
            parts.append(one.select("digest", F.col("doc_id").alias("min_id"), F.col("doc_id").alias("max_id"), F.lit(1).cast("long").alias("rows")))
        return reduce(DataFrame.unionByName, parts)

    def compact(self) -> DataFrame:
        """Merges all runs into one sorted run: digest, min_id, max_id, rows; and writes the bitmap beside it."""
        merged = self.entries().groupBy("digest").agg(F.min("min_id").alias("min_id"), F.max("max_id").alias("max_id"), F.sum("rows").alias("rows"))
        self.flushes += 1
        target = f"{self.path}/level-1/{self.flushes}"
        table = written(merged.sortWithinPartitions("digest"), "run", RUN_OPTIONS, target)
        self.runs, self.merged = [], target
        hits = written(table.filter("rows > 1"), "hits", path=f"{target}-hits")
        self.bits = min(MOST_FILTER_BITS, 1 << max(16, (FILTER_BITS * hits.count()).bit_length()))
        at = hits.select(F.explode(F.array(*self._positions(F.col("digest")))).alias("at"))
        words = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits"))
        written(words, "bitmap", path=f"{target}-bitmap")
        return table

    def hits(self) -> DataFrame:
        """The compacted run's digests with several rows."""
        return self.spark.read.parquet(f"{self.merged}-hits")

    def _positions(self, digest: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(F.lit(n), digest), F.lit(self.bits)) for n in range(2)]

    def may_repeat(self) -> Callable[[Column], Column]:
        """A function of digests that is false only for those with one row, by the bitmap of the compacted run."""
        found = self.spark.read.parquet(f"{self.merged}-bitmap").toArrow()  # at most MOST_FILTER_BITS / 64 rows
        bitmap = np.zeros(self.bits // 64, dtype=np.int64)
        bitmap[found["word"].to_numpy()] = found["bits"].to_numpy()
        shared = self.spark.sparkContext.broadcast(bitmap)

        @F.arrow_udf("boolean")
        def set_in_bitmap(a: pa.Array, b: pa.Array) -> pa.Array:
            result = np.ones(len(a), dtype=bool)
            for at in (a.to_numpy(), b.to_numpy()):
                result &= (shared.value[at >> 6] >> (at & 63)) & 1 == 1
            return pa.array(result)

        return lambda digest: set_in_bitmap(*self._positions(digest))

    def lookup(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """doc_id, digest and, where the index has the digest, its min_id, max_id and rows, else null."""
        known = self.entries().groupBy("digest").agg(F.min("min_id").alias("min_id"), F.max("max_id").alias("max_id"), F.sum("rows").alias("rows"))
        return self.keyed(docs, id_col, text_col).join(known, "digest", "left")

    def find(self, digests: list[str]) -> DataFrame:
        """The entries of a few digests; files whose Bloom filters rule them out aren't read."""
        return self.entries().filter(F.col("digest").isin(digests))


def resolve(docs: DataFrame, keep: str = "smallest", id_col: str = "doc_id", text_col: str = "text", index: DigestIndex | None = None) -> DataFrame:
    """One row per document: doc_id, digest, keep_id, group_size, kept. keep: "smallest" or "largest" doc_id."""
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is smallest or largest")
    index = index or DigestIndex(docs.sparkSession)
    rows = index.append(docs, id_col, text_col)
    index.compact()
    may_repeat = index.may_repeat()
    chosen = F.col("min_id" if keep == "smallest" else "max_id").alias("keep_id")
    groups = index.hits().select("digest", chosen, F.col("rows").alias("group_size"))
    alone = rows.filter(~may_repeat(F.col("digest"))).select("doc_id", "digest", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    hits = attach(rows.filter(may_repeat(F.col("digest"))), groups, "digest", "group_size", rows.count()).select("doc_id", "digest", "keep_id", "group_size")
    # Byte verification: a group's smallest and largest text are its only one. Each task sends two texts for a group at most.
    texts = docs.select(F.col(id_col).alias("doc_id"), index.digest(text_or_empty(text_col)).alias("digest"), text_or_empty(text_col).alias("text"))
    compared = texts.filter(may_repeat(F.col("digest"))).groupBy("digest").agg(F.min("text").alias("low"), F.max("text").alias("high"))
    clashing = written(compared.filter("low <> high").select("digest"), "clashing")
    if not clashing.isEmpty():
        best = F.min if keep == "smallest" else F.max
        apart = texts.join(clashing, "digest")
        several = apart.groupBy("digest", "text").agg(best("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        again = apart.join(several, ["digest", "text"]).select("doc_id", "digest", "keep_id", "group_size")
        hits = hits.join(clashing, "digest", "left_anti").select(*again.columns).unionByName(again)
    found = alone.unionByName(hits)
    keep_id = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return found.select("doc_id", "digest", keep_id.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep_id).alias("kept"))


def deduplicate(docs: DataFrame, keep: str = "largest") -> DataFrame:
    """One document of each group of equal texts stays; the columns stay as they are.

    Rows that the index's bitmap rules out stay where they are read. Of the others those that don't stay are taken
    out by id and digest, and rows that repeat both are counted once.
    """
    index = DigestIndex(docs.sparkSession)
    out = written(resolve(docs, keep, index=index).filter("group_size > 1"), "resolved")
    gone = out.filter(~F.col("kept")).select("doc_id", "digest").distinct()
    repeated = written(out.filter("kept").groupBy("doc_id", "digest").agg(F.count("*").alias("n")).filter("n > 1").select("digest").distinct(), "repeated")
    own, own_id = "_citemill_digest", "_citemill_id"
    may_repeat = index.may_repeat()
    marked = docs.withColumn(own, sha256(text_or_empty()))
    alone = marked.filter(~may_repeat(F.col(own)))
    gone = gone.select(F.col("doc_id").alias(own_id), F.col("digest").alias(f"{own}_gone"))
    same = (F.col(own) == F.col(f"{own}_gone")) & F.col("doc_id").eqNullSafe(F.col(own_id))
    stays = marked.filter(may_repeat(F.col(own))).join(gone, same, "left_anti")
    if not repeated.isEmpty():
        again = repeated.withColumnRenamed("digest", own)
        stays = stays.join(again, own, "left_anti").unionByName(stays.join(again, own, "left_semi").dropDuplicates([own, "doc_id"]))
    return alone.unionByName(stays).drop(own)


def op6_digest_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resolve(read_table(spark, sf_dir, "documents"), "largest")
    return found.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))
