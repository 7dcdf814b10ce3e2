"""Near-duplicates by SimHash, linked with a segment-popcount embedding.

A fingerprint's 64 bits are cut into 16 segments of 4; the bit counts of the segments place it on a grid. The
Manhattan distance of two places never exceeds the Hamming distance of the fingerprints, so a range join on the
grid finds every pair that can be near, and comparing the fingerprints themselves decides.

Two places at distance 2 or less have a place within 1 of both. So the range join is an equi-join: each
fingerprint goes to its own cell and to those one step away. A cell with few members compares its pairs. In a
crowded cell the segments are refined to single bits, where the Manhattan distance is the Hamming distance: the
members that reach the same refined place are all within two bits of each other, and linking them to
the smallest loses no connection, with rows in proportion to the members.

Defined results: a null text counts as empty; texts without words have fingerprint 0 and are linked like others;
rows with equal fingerprints are in one component; a null doc_id is never chosen as component_id unless the
component has no other; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citemill.llm.common import attach, bounded, read_table, text_or_empty, written
from citemill.operators.graph import link_components

SHINGLE_WORDS = 3
MAX_BITS = 2
SEED = 42
#: Cells with more members than this are refined to single bits.
CROWDED = 32
#: Segments of four bits, one hexadecimal digit of a place.
SEGMENTS = 16


def simhash(text: str, words: int = SHINGLE_WORDS) -> int:
    """The 64-bit fingerprint of a text: a bit is set if over half the shingle hashes have it."""
    parts = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not parts:
        return 0
    if len(parts) <= words:
        shingles = [b" ".join(parts)]
    else:
        shingles = map(b" ".join, zip(*(parts[i:] for i in range(words))))
    digest = xxhash.xxh64_intdigest
    return majority(np.fromiter((digest(s, SEED) for s in shingles), dtype="<u8"))


def majority(hashes: np.ndarray) -> int:
    """The number whose bits are those that more than half of the unsigned 64-bit hashes have."""
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 4096):
        block = hashes[at : at + 4096].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(counts * 2 > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """A hash that, together with the id, rows share only if they repeat id and text."""
    return F.xxhash64(F.col(id_col), F.col(text_col))


def repeated_rows(rows: DataFrame) -> DataFrame:
    """row_key of the rows (doc_id, row_key) that repeat both, written."""
    return written(rows.groupBy("doc_id", "row_key").agg(F.count("*").alias("n")).filter("n > 1").select("row_key").distinct(), "repeated")


def keep_rows(docs: DataFrame, rows: DataFrame, kept: DataFrame, repeated: DataFrame) -> DataFrame:
    """The rows of docs that kept (doc_id, row_key) names, each once, with the columns of docs. rows has doc_id and row_key of
    all. The rows that go are named, and only those whose row_key is in repeated move to be counted once."""
    key, key_id = "_citemill_row", "_citemill_id"
    stay = kept.select(F.col("doc_id").alias(key_id), F.col("row_key").alias(f"{key}_kept"))
    of_rows = (F.col("row_key") == F.col(f"{key}_kept")) & F.col("doc_id").eqNullSafe(F.col(key_id))
    gone = rows.select("doc_id", "row_key").join(stay, of_rows, "left_anti").select(F.col("doc_id").alias(key_id), F.col("row_key").alias(f"{key}_gone")).distinct()
    same = (F.col(key) == F.col(f"{key}_gone")) & F.col("doc_id").eqNullSafe(F.col(key_id))
    stays = docs.withColumn(key, row_key()).join(bounded(written(gone, "gone")), same, "left_anti")
    if repeated.isEmpty():
        return stays.drop(key)
    again = bounded(repeated.select(F.col("row_key").alias(key)))
    return stays.join(again, key, "left_anti").unionByName(stays.join(again, key, "left_semi").dropDuplicates([key, "doc_id"])).drop(key)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS) -> DataFrame:
    """One row per document: its id as doc_id, row_key, and fp, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [simhash(t.as_py(), words) for t in batch.column(2)]
            prints = pa.array(np.array(found, dtype=np.uint64).view(np.int64), type=pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), prints], names=["doc_id", "row_key", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), row_key(id_col, text_col).alias("row_key"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, row_key long, fp long")


def _place() -> Column:
    """The bit counts of the 16 segments of fp, four bits each. Half words at a time: no sum reaches the sign."""

    def half(x: Column) -> Column:
        pairs = x.bitwiseAND(F.lit(0x55555555)) + F.shiftrightunsigned(x, 1).bitwiseAND(F.lit(0x55555555))
        return pairs.bitwiseAND(F.lit(0x33333333)) + F.shiftrightunsigned(pairs, 2).bitwiseAND(F.lit(0x33333333))

    low = half(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)))
    high = half(F.shiftrightunsigned("fp", 32))
    return F.shiftleft(high, 32).bitwiseOR(low)


def _cells(prints: DataFrame) -> DataFrame:
    """(fp, cell): the own place of each fingerprint and those that differ by one in one segment."""
    place = prints.select("fp", _place().alias("place"))
    steps = []
    for i in range(SEGMENTS):
        unit = F.lit(1 << (4 * i))
        count = F.shiftrightunsigned("place", 4 * i).bitwiseAND(F.lit(15))
        steps += [F.when(count < 4, F.col("place") + unit), F.when(count > 0, F.col("place") - unit)]
    return place.select("fp", F.explode(F.array_compact(F.array(F.col("place"), *steps))).alias("cell"))


def _flips(prints: DataFrame) -> DataFrame:
    """(fp, cell) in the refined grid: each fingerprint and its 64 neighbours at one bit."""
    masks = [0] + [1 << i for i in range(63)] + [-(1 << 63)]
    return prints.select("fp", F.explode(F.array(*[F.col("fp").bitwiseXOR(F.lit(m)) for m in masks])).alias("cell"))


def near_links(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Links (a, b), a < b, between different fingerprints that differ in at most two bits.

    prints has one row per fingerprint, in fp. All links follow from these by transitivity; in cells with few
    members every link is given. The result may repeat links.
    """
    if not 1 <= max_bits <= 2:
        raise ValueError("steps of one segment reach a distance of 2")
    cells = _cells(prints)
    sizes = written(cells.groupBy("cell").agg(F.count("*").alias("members")).filter("members > 1"), "simhash-cells")
    members = written(cells.join(sizes, "cell"), "simhash-members")
    few = members.filter(F.col("members") <= CROWDED).select("cell", "fp")
    pairs = few.withColumnRenamed("fp", "a").join(few.withColumnRenamed("fp", "b"), "cell").filter("a < b").select("a", "b")
    crowd = written(members.filter(F.col("members") > CROWDED).select("fp").distinct(), "simhash-crowd")
    refined = written(_flips(crowd).groupBy("cell").agg(F.min("fp").alias("a"), F.count("*").alias("members")).filter("members > 1"), "simhash-refined")
    stars = _flips(crowd).withColumnRenamed("fp", "b").join(refined.select("cell", "a"), "cell").filter("a < b").select("a", "b")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    return pairs.filter(near).unionByName(stars.filter(near)).distinct()


def link_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per document: doc_id, fp (long), component_id, component_size (documents in the component), and
    row_key and stays: of each component the rows that equal the one with the smallest doc_id stay."""
    prints = written(fingerprints(docs, id_col, text_col, words), "fingerprints")
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key")
    classes = written(prints.groupBy("fp").agg(F.min(first).alias("low"), F.count("*").alias("rows")), "classes")
    roots = link_components(near_links(classes.select("fp"), max_bits)).select(F.col("node").alias("fp"), "root")
    rooted = classes.join(roots, "fp", "left").select("fp", "low", "rows", F.coalesce("root", "fp").alias("root"))
    rooted = written(rooted, "rooted")
    whole = rooted.groupBy("root").agg(F.min("low").alias("first"), F.sum("rows").alias("component_size"), F.count("*").alias("prints"))
    linked = written(whole.filter("prints > 1").drop("prints"), "linked")
    several = rooted.join(linked, "root").select("fp", "first", "component_size", "rows")
    alone = rooted.join(linked.select("root"), "root", "left_anti").select("fp", F.col("low").alias("first"), F.col("rows").alias("component_size"), "rows")
    table = written(alone.unionByName(several), "components")
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("row_key") == F.col("first.row_key"))
    return attach(prints, table, "fp", "rows", prints.count()).select("doc_id", "fp", F.col("first.doc_id").alias("component_id"), "component_size", "row_key", stays.alias("stays"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """One document of each component stays, that with the smallest doc_id; the columns stay as they are.

    Rows with the same doc_id and text as the one that stays count as one. Rows without doc_id yield to others;
    among themselves the smallest hash stays.
    """
    linked = written(link_documents(docs), "linked-rows")
    return keep_rows(docs, linked, linked.filter("stays").select("doc_id", "row_key").distinct(), repeated_rows(linked))


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = link_documents(read_table(spark, sf_dir, "documents"))
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return linked.select("doc_id", digits.alias("fingerprint"), "component_id", "component_size")
