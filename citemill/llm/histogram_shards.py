"""Sharding by histogram sort: splitters from exact byte counts, then one exchange.

Documents are ordered by a hash of the text, within equal texts by a hash of the id, and rows that repeat both by a hash of
the number they got when they were written. The splitters between shards are found without moving rows: each round counts
the exact bytes and rows between probe keys, in all partitions at once, and puts the next probes inside the one interval
that holds a splitter's target. The driver sees counts for at most PROBES intervals a splitter and round, whatever the size
of the table.

Equal texts are neighbours in that order, so they share a shard, unless a splitter would have to move by more than
GROUP_TOLERANCE to spare the group; then it goes between two of the group's rows.

Slots number a shard's rows in the order of their keys. Rows are numbered in lots, stretches of the order: a lot is a prefix
of the key, longer where many rows have it, so large groups of equal texts or rows are many lots.

Defined results: a null text has no bytes and crc32 0; an empty table gives an empty table; repeated rows are
separate documents with slots of their own; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citemill.llm.common import read_table, text_or_empty, written

SHARDS = 24
ROW_OVERHEAD = 8
#: How far, as a share of a shard's bytes, a splitter may be from its target.
TOLERANCE = 0.005
#: The same for a splitter that would cut a group of equal texts: within this share it goes to the group's nearer end.
GROUP_TOLERANCE = 0.025
#: Each round cuts an interval into 2 ** PROBE_BITS.
PROBE_BITS = 10
KEY_BITS = 62
#: Rows that one task numbers at a time, about; a lot of LOT_LIMIT times as many gets a longer prefix.
SLOT_ROWS = 2_000
LOT_LIMIT = 4
#: The columns of the order, 62 bits each, and as hexadecimal digits of a key.
LEVELS = ("text_key", "id_key", "row_key")
DIGITS = 16


@dataclass
class Splitter:
    """The keys below it belong to shards up to its number. low, bits: the interval of keys that holds the target, among the
    rows whose keys of the levels above are those in within; inside: bytes of the target beyond the interval's start; size:
    bytes of a single key, where that is as far as the search gets; done: the final key."""

    number: int
    low: int
    bits: int
    inside: int
    within: tuple[int, ...] = ()
    size: int = 0
    done: int | None = None


def _key(hashed: Column) -> Column:
    return F.shiftrightunsigned(hashed, 64 - KEY_BITS)


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    text = text_or_empty(text_col)
    return docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + ROW_OVERHEAD).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        _key(F.xxhash64(text)).alias("text_key"),
        _key(F.xxhash64(F.lit("order"), F.col(id_col))).alias("id_key"),
        _key(F.xxhash64(F.lit("row"), F.monotonically_increasing_id())).alias("row_key"),
    )


def _counts(rows: DataFrame, column: str, open_: list[Splitter]) -> dict[tuple, list[int]]:
    """For each interval that holds splitters: exact bytes in each of its probes. {(within, low, bits): bytes by probe}"""
    intervals = sorted({(s.within, s.low, s.bits) for s in open_})
    above = lambda within: "".join(f" and {c} = {k}L" for c, k in zip(LEVELS, within))
    found = {x: [0] * (1 << min(PROBE_BITS, x[2])) for x in intervals}
    cases = []
    for n, (within, low, bits) in enumerate(intervals):
        here = f"shiftright({column}, {bits}) = {low >> bits}L{above(within)}"
        cases.append(f"when {here} then struct({n} as n, cast(shiftright({column} - {low}L, {max(0, bits - PROBE_BITS)}) as int) as probe)")
    counted = rows.select(F.expr(f"case {' '.join(cases)} end").alias("at"), "size").filter("at is not null").groupBy("at").agg(F.sum("size").alias("bytes"))
    for (n, probe), there in counted.collect():  # at most 2 ** PROBE_BITS rows for each of the splitters
        found[intervals[n]][probe] = there
    return found


def _search(rows: DataFrame, column: str, splitters: list[Splitter], slack: int) -> list[Splitter]:
    """Refines the intervals until each splitter's key is within slack bytes of its target; gives those that end
    inside a single key, which has too many bytes."""
    open_ = [s for s in splitters if s.done is None]
    heavy = []
    while open_:
        found = _counts(rows, column, open_)
        still = []
        for s in open_:
            width, before = max(0, s.bits - PROBE_BITS), 0
            counts = found[s.within, s.low, s.bits]
            for probe, there in enumerate(counts):
                if before + there >= s.inside or probe == len(counts) - 1:
                    break
                before += there
            below, above = s.inside - before, before + there - s.inside
            s.low += probe << width
            if min(below, above) <= slack:
                s.done = s.low + (above < below) * (1 << width)
            else:
                s.bits, s.inside, s.size = width, below, there
                (still if width else heavy).append(s)
        open_ = still
    return heavy


def splitters(rows: DataFrame, shards: int, total: int, tolerance: float = TOLERANCE, group_tolerance: float = GROUP_TOLERANCE) -> list[tuple[int, ...]]:
    """Keys (text_key, id_key, row_key), ascending: a row belongs to the shard numbered by how many of them are at or below its
    own key."""
    slack = int(total / shards * tolerance)
    searched = [Splitter(n, 0, KEY_BITS, total * n // shards) for n in range(1, shards)]
    keys = []
    for level, column in enumerate(LEVELS):
        here = rows.filter(F.col("text_key").isin(sorted({s.within[0] for s in searched}))) if level else rows
        heavy = _search(here, column, searched, slack)
        for s in heavy:
            # Groups of equal texts are spared within the tolerance; a single row goes to its nearer side.
            if level == len(LEVELS) - 1 or (not level and min(s.inside, s.size - s.inside) <= total / shards * group_tolerance):
                s.done = s.low + (2 * s.inside > s.size)
        rest = (0,) * (len(LEVELS) - level - 1)
        keys += [(*s.within, s.done, *rest) for s in searched if s.done is not None]
        searched = [Splitter(s.number, 0, KEY_BITS, s.inside, (*s.within, s.low)) for s in heavy if s.done is None]
        if not searched:
            break
    return sorted(keys)


def _shard(keys: list[tuple[int, ...]]) -> Column:
    """The number of splitters at or below a row's key, as a balanced tree of comparisons."""

    def below(key: tuple[int, ...], level: int = 0) -> Column:
        less = F.col(LEVELS[level]) < F.lit(key[level])
        return less | ((F.col(LEVELS[level]) == F.lit(key[level])) & below(key, level + 1)) if any(key[level + 1 :]) else less

    def tree(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(below(keys[middle]), tree(low, middle)).otherwise(tree(middle + 1, high))

    return tree(0, len(keys))


def with_lots(rows: DataFrame, lots: int) -> DataFrame:
    """rows with key, the digits of their place in the order, and lot, a prefix of it; no lot is a prefix of another, so
    lots in their order are the rows in theirs.

    Lots start with prefixes that all rows share evenly. Each round looks at the lots with too many rows and cuts them
    behind what all their keys have in common.
    """
    key = F.concat(*[F.lpad(F.hex(c), DIGITS, "0") for c in LEVELS])
    digits = max(1, -(-(max(1, lots).bit_length() + 64 - KEY_BITS) // 4))
    rows = rows.withColumn("key", key).withColumn("lot", F.substring("key", 1, digits))
    common = F.length(F.regexp_extract(F.concat_ws("|", "low", "high"), r"^([0-9A-F]*)[0-9A-F]*\|\1", 1))
    for _ in range(3 * len(LEVELS)):
        crowded = rows.groupBy("lot").agg(F.count("*").alias("rows"), F.min("key").alias("low"), F.max("key").alias("high")).filter(F.col("rows") > LOT_LIMIT * SLOT_ROWS)
        more = F.ceil(F.log2(F.col("rows") / SLOT_ROWS) / 4).cast("int")
        crowded = written(crowded.select("lot", (common + more).alias("digits")).filter("digits > length(lot)"), "crowded")
        if crowded.isEmpty():
            break
        longer = F.when(F.col("digits").isNull(), F.col("lot")).otherwise(F.expr("substring(key, 1, digits)"))
        rows = rows.join(crowded, "lot", "left").withColumn("lot", longer).drop("digits")
    return rows


def shard_by_bytes(docs: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard and slot (0, 1, ... in each shard) of every document."""
    rows = written(sized(docs, id_col, text_col), "sized")
    total, count = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    placed = rows.withColumn("shard", _shard(splitters(rows, shards, total, tolerance)) if total else F.lit(0))
    placed = with_lots(placed, count // SLOT_ROWS)
    by_shard = Window.partitionBy("shard").orderBy("lot").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("shard", "lot").agg(F.count("*").alias("rows"))
    starts = written(starts.withColumn("start", F.coalesce(F.sum("rows").over(by_shard), F.lit(0))).drop("rows"), "lots")
    in_lot = Window.partitionBy("shard", "lot").orderBy(*LEVELS)
    numbered = placed.withColumn("at", F.row_number().over(in_lot) - 1)
    return numbered.join(starts, ["shard", "lot"]).select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("at")).cast("long").alias("slot"))


def op2_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_by_bytes(read_table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
