"""Hard negatives by exact inner products: a k-nearest-neighbour join over Voronoi cells.

Vectors are whole numbers. With M the greatest squared length, each row x gets one more coordinate, sqrt(M - |x|^2), and each
anchor a zero; then |a - x|^2 = |a|^2 + M - 2 a.x, so the greatest inner products are the nearest rows, and the triangle
inequality holds. Rows go to the cell of their nearest pivot, anchors too, and the anchors of a cell are dealt into groups. A
group with radius r around its pivot p can be served by a row x of the cell of q, at distance d from q, only if some anchor's
reach meets the range |pq| - d - r to |pq| + d + r. So a row is copied to the groups that it might serve, by a join of its
cell with the groups' bounds, and each group is joined exactly with its rows by blocks of a matrix product.

1. Positives. A group holds anchors of one label. Its reach is the k-th smallest of r + |pq| + s, where s are the distances of each
   cell's nearest rows of the label: so many rows are that near to every anchor.
2. Negatives. A group holds anchors of any label, with their positives' scores. Its reach is the distance of the lowest score that a
   positive allows, and rows nearer than the highest allowed one are left out as well.

Tasks read a group's anchors first, then its rows as they stream by, and keep only the best so far; groups are split into lots of
LOT_ROWS rows, whose bests are merged. Float products are exact below 2^53, beyond it whole numbers are multiplied.

Defined results: rows that repeat vec_id, label and vector count once; the label is changed before that; rows that share a vec_id
otherwise are rows of their own, but not "other rows" to each other; a null vec_id is no anchor and comes last among ties; shorter
vectors are padded with zeros, and an empty one is all zeros; rows whose squared length is 2^61 or more (its scores would not fit
in a long) take no part; a positive with a negative score has no negatives; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citemill.llm.common import bounded, read_table, written

SCALE = 256
LARGEST = 2.0**61
#: Anchors of a group, rows of a lot, and numbers of a block of scores.
GROUP, LOT_ROWS, BLOCK = 4096, 1 << 20, 1 << 20
#: One pivot for so many anchors, within these bounds.
ANCHORS_A_PIVOT, LEAST_PIVOTS, MOST_PIVOTS = 1024, 4, 256
ROW = "vec_id long, label int, vec binary"
BEST = f"{ROW}, place int, found_id long, score long"


@dataclass(frozen=True)
class Mining:
    """Which rows are anchors, how many positives and negatives they get, and the range of a negative's score: low * positive <=
    of * negative <= high * positive."""

    every: int = 100
    relabel_every: int = 7
    labels: int = 10
    positives: int = 5
    negatives: int = 10
    low: int = 30
    high: int = 90
    of: int = 100

    def allowed(self, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and greatest whole scores of a negative, without overflow. For a negative score, no range."""
        whole, rest = np.divmod(score, self.of)
        return self.low * whole - (-self.low * rest) // self.of, self.high * whole + self.high * rest // self.of


def prepared(rows: DataFrame, mining: Mining = Mining()) -> DataFrame:
    """vec_id, label (changed where it must be) and vec (little-endian 32-bit numbers) of the rows that take part, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pc.and_(pc.is_valid(batch.column(1)), pc.is_valid(batch.column(2))))
            sizes = pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
            x = np.floor(SCALE * pc.fill_null(batch.column(2).flatten().cast(pa.float64()), np.nan).to_numpy(zero_copy_only=False))
            with np.errstate(over="ignore", invalid="ignore"):
                squares = np.concatenate([[0], np.where(np.isfinite(x), x, 0) ** 2])
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
            kept, vectors = [], []
            for i, (start, end) in enumerate(zip(ends, ends[1:])):
                if bad[end] == bad[start] and squares[start + 1 : end + 1].sum() < LARGEST:
                    kept.append(i)
                    vectors.append(x[start:end].astype("<i4").tobytes())
            part = batch.take(pa.array(kept, type=pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(vectors, type=pa.binary())], names=["vec_id", "label", "vec"])

    label = F.when(F.col("vec_id") % mining.relabel_every == 0, (F.col("label") + 1) % mining.labels).otherwise(F.col("label"))
    table = rows.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("int").alias("label"), "embedding")
    return table.mapInArrow(run, ROW).distinct()


def matrix(vectors: pa.Array, dim: int) -> np.ndarray:
    """Rows of binary vectors as a matrix, padded with zeros."""
    parts = [v.ljust(4 * dim, b"\0") for v in vectors.to_pylist()]
    return np.frombuffer(b"".join(parts), dtype="<i4").reshape(len(parts), dim)


@dataclass(frozen=True)
class Space:
    """The augmented space: dimension without the added coordinate, greatest squared length, and pivots as matrix rows."""

    dim: int
    longest: float
    pivots: np.ndarray

    def augmented(self, x: np.ndarray, anchors: bool = False) -> np.ndarray:
        x = x.astype(np.float64)
        added = np.zeros(len(x)) if anchors else np.sqrt(np.maximum(self.longest - (x * x).sum(axis=1), 0))
        return np.column_stack([x, added])

    @property
    def slack(self) -> float:
        """More than distances can be off by rounding."""
        return 1e-6 * (1 + self.longest**0.5)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        far = (x * x).sum(axis=1)[:, None] + (self.pivots * self.pivots).sum(axis=1)[None] - 2 * x @ self.pivots.T
        cell = far.argmin(axis=1)
        return cell.astype(np.int32), np.sqrt(np.maximum(far[np.arange(len(x)), cell], 0))

    def placed(self, rows: DataFrame, anchors: bool = False) -> DataFrame:
        """rows with cell and dist, and length, the squared length."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = matrix(batch.column("vec"), self.dim)
                cell, dist = self.nearest(self.augmented(x, anchors))
                length = (x.astype(np.float64) ** 2).sum(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(dist), pa.array(length)], names=[*batch.schema.names, "cell", "dist", "length"])

        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
        return rows.mapInArrow(run, f"{kinds}, cell int, dist double, length double")

    def between(self, spark: SparkSession) -> DataFrame:
        """(cell, other, apart) for all pairs of pivots: at most MOST_PIVOTS^2 rows."""
        apart = np.sqrt(((self.pivots[:, None] - self.pivots[None]) ** 2).sum(axis=2))
        table = [(i, j, float(apart[i, j])) for i in range(len(apart)) for j in range(len(apart))]
        return F.broadcast(spark.createDataFrame(table, "cell int, other int, apart double"))


def space_of(rows: DataFrame, anchors: int, pivots: int | None = None) -> Space:
    """The space of written rows. Pivots are the rows with the smallest hashes."""
    size = rows.agg(F.max(F.length("vec")).alias("bytes")).first()["bytes"] or 0
    dim = size // 4
    n = pivots or min(MOST_PIVOTS, max(LEAST_PIVOTS, anchors // ANCHORS_A_PIVOT))
    hashed = F.xxhash64("vec_id", "label", "vec")
    chosen = rows.select("vec", hashed.alias("h")).orderBy("h").limit(n).toArrow()

    def longest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = max(((matrix(b.column(0), dim).astype(np.float64) ** 2).sum(axis=1).max(initial=0) for b in batches), default=0.0)
        yield pa.RecordBatch.from_arrays([pa.array([float(most)])], names=["longest"])

    found = Space(dim, rows.select("vec").mapInArrow(longest, "longest double").agg(F.max("longest")).first()[0] or 0.0, np.empty((0, dim + 1)))
    return Space(dim, found.longest, found.augmented(matrix(pa.chunked_array(chosen["vec"].chunks, type=pa.binary()).combine_chunks(), dim)))


def dealt(anchors: DataFrame, size: int, *by: str) -> DataFrame:
    """anchors with group: those of a cell (and of further columns) in lots of about the given size."""
    sizes = anchors.groupBy("cell", *by).agg(F.ceil(F.count("*") / size).alias("lots"))
    lot = F.pmod(F.xxhash64("vec_id", "vec"), F.col("lots"))
    return anchors.join(sizes, ["cell", *by]).withColumn("group", F.xxhash64("cell", *by, lot)).drop("lots")


def served(rows: DataFrame, groups: DataFrame, space: Space, *by: str) -> DataFrame:
    """(group, vec_id, label, vec): rows with each group of groups (group, cell, radius, nearest, reach and further columns) that they
    might serve."""
    bounds = groups.join(space.between(rows.sparkSession), "cell")
    low = F.greatest(F.col("apart") - F.col("radius") - F.col("reach"), F.col("nearest") - F.col("apart") - F.col("radius")) - space.slack
    bounds = bounds.select("group", F.col("other").alias("cell"), *by, low.alias("low"), (F.col("reach") + F.col("apart") + F.col("radius") + space.slack).alias("high"))
    return rows.join(bounded(written(bounds, "cell-bounds")), ["cell", *by]).filter("dist between low and high").select("group", "vec_id", "label", "vec")


@dataclass
class Best:
    """The best candidates of a group's anchors so far. For each slot (an anchor and a place) at most most pairs of score and id."""

    mining: Mining
    space: Space
    positives: bool

    def __post_init__(self) -> None:
        self.anchors: list[pa.RecordBatch] = []
        self.ready = False

    def _start(self) -> None:
        self.ready = True
        self.rows = pa.Table.from_batches(self.anchors).combine_chunks()
        n = self.rows.num_rows
        self.places, self.most = (1, self.mining.positives) if self.positives else (self.mining.positives, self.mining.negatives)
        self.x = self._matrix(self.rows["vec"].combine_chunks())
        self.id, self.no_id = _ids(self.rows["vec_id"].combine_chunks())
        self.label = self.rows["label"].to_numpy()
        self.low = np.full((n, self.places), np.iinfo(np.int64).min)
        self.high = np.full((n, self.places), np.iinfo(np.int64).max)
        if not self.positives:
            # A place without a positive, or with a negative score, allows nothing.
            score = np.full((n, self.places), -1, dtype=np.int64)
            for i, found in enumerate(self.rows["scores"].to_pylist()):
                score[i, : len(found)] = found
            self.low, self.high = self.mining.allowed(score)
            self.low[score < 0], self.high[score < 0] = 1, 0
        self.slot, self.score, self.found, self.no_found = (np.empty(0, dtype=t) for t in (np.int64, np.int64, np.int64, bool))

    def _matrix(self, vectors: pa.Array) -> np.ndarray:
        """In a type in which products are exact."""
        return matrix(vectors, self.space.dim).astype(np.float64 if self.space.longest < 2**53 else np.int64)

    def add(self, batch: pa.RecordBatch) -> None:
        if not self.ready:
            self._start()
        step = max(1, BLOCK // max(1, len(self.x)))
        for at in range(0, batch.num_rows, step):
            self._block(batch.slice(at, step))

    def _block(self, batch: pa.RecordBatch) -> None:
        scores = self.x @ self._matrix(batch.column("vec")).T
        ids, no_ids = _ids(batch.column("vec_id"))
        same = self.label[:, None] == batch.column("label").to_numpy()[None]
        fits = same & ((self.id[:, None] != ids[None]) | no_ids[None]) if self.positives else ~same
        fits &= (scores >= self.low.min(axis=1)[:, None]) & (scores <= self.high.max(axis=1)[:, None])
        a, c = np.nonzero(fits)
        score = scores[a, c].astype(np.int64)
        parts = []
        for place in range(self.places):
            inside = (score >= self.low[a, place]) & (score <= self.high[a, place])
            parts.append((a[inside] * self.places + place, score[inside], ids[c[inside]], no_ids[c[inside]]))
        self._keep(parts)

    def _keep(self, parts: list[tuple[np.ndarray, ...]]) -> None:
        slot, score, found, no_found = (np.concatenate(x) for x in zip((self.slot, self.score, self.found, self.no_found), *parts))
        order = np.lexsort((found, no_found, -score, slot))
        slot = slot[order]
        first = np.searchsorted(slot, slot)
        best = np.arange(len(slot)) - first < self.most
        kept = order[best]
        self.slot, self.score, self.found, self.no_found = slot[best], score[kept], found[kept], no_found[kept]
        # A full slot takes no lower score than its last.
        last = np.arange(len(self.slot)) - np.searchsorted(self.slot, self.slot) == self.most - 1
        low = self.low.reshape(-1)
        low[self.slot[last]] = np.maximum(low[self.slot[last]], self.score[last])

    def rows_out(self) -> Iterator[pa.RecordBatch]:
        if not self.ready:
            return
        for at in range(0, len(self.slot), 10_000):
            part = slice(at, at + 10_000)
            rows = self.rows.take(pa.array(self.slot[part] // self.places)).combine_chunks()
            columns = [rows[c].combine_chunks() for c in ("vec_id", "label", "vec")]
            found = pa.array(self.found[part], mask=self.no_found[part])
            yield pa.RecordBatch.from_arrays([*columns, pa.array((self.slot[part] % self.places).astype(np.int32)), found, pa.array(self.score[part])], names=["vec_id", "label", "vec", "place", "found_id", "score"])


def _ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return pc.fill_null(column, 0).to_numpy(zero_copy_only=False), pc.is_null(column).to_numpy(zero_copy_only=False)


def best_of(anchors: DataFrame, rows: DataFrame, space: Space, mining: Mining, positives: bool, lots: int) -> DataFrame:
    """BEST rows: for each anchor and place the best of the rows that came to its group, merged over lots."""
    lot = F.explode(F.sequence(F.lit(0), F.lit(lots - 1))).alias("lot")
    scores = F.lit(None).cast("array<long>") if positives else F.col("scores")
    first = anchors.select("group", lot, F.lit(0).alias("kind"), "vec_id", "label", "vec", scores.alias("scores"))
    then = rows.select("group", F.pmod(F.xxhash64("vec_id", "vec"), F.lit(lots)).cast("int").alias("lot"), F.lit(1).alias("kind"), "vec_id", "label", "vec", F.lit(None).cast("array<long>").alias("scores"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, best = None, None
        for batch in batches:
            keys = np.column_stack([batch.column(i).to_numpy() for i in range(3)])
            starts = np.concatenate([[0], np.nonzero((keys[1:] != keys[:-1]).any(axis=1))[0] + 1, [len(keys)]]).astype(np.int64)
            for start, end in zip(starts, starts[1:]):
                if end == start:
                    continue
                group, lot_, kind = (int(k) for k in keys[start])
                if (group, lot_) != now:
                    if best:
                        yield from best.rows_out()
                    now, best = (group, lot_), Best(mining, space, positives)
                part = batch.slice(start, end - start)
                best.anchors.append(part) if kind == 0 else best.add(part)
        if best:
            yield from best.rows_out()

    together = first.unionByName(then).repartition("group", "lot").sortWithinPartitions("group", "lot", "kind")
    found = together.mapInArrow(run, BEST)
    order = Window.partitionBy("vec_id", "label", "vec", "place").orderBy(F.desc("score"), F.asc_nulls_last("found_id"))
    most = mining.positives if positives else mining.negatives
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def positives_of(anchors: DataFrame, rows: DataFrame, space: Space, mining: Mining, group: int, lots: int) -> DataFrame:
    """Anchors with ids and scores, the lists of their positives."""
    needed = mining.positives + 1  # the anchor may be among them
    placed = written(dealt(space.placed(anchors, anchors=True), group, "label"), "anchors-by-label")
    groups = placed.groupBy("group", "cell", "label").agg(F.max("dist").alias("radius"))
    near = rows.withColumn("place", F.row_number().over(Window.partitionBy("cell", "label").orderBy("dist"))).filter(F.col("place") <= needed)
    near = near.select(F.col("cell").alias("other"), "label", F.col("dist").alias("near"))
    reach = groups.join(space.between(rows.sparkSession), "cell").join(near, ["other", "label"]).groupBy("group").agg(F.array_sort(F.collect_list(F.col("radius") + F.col("apart") + F.col("near"))).alias("reaches"))
    reach = reach.select("group", F.coalesce(F.get("reaches", F.lit(needed - 1)), F.lit(float("inf"))).alias("reach"))
    groups = groups.join(reach, "group").withColumn("nearest", F.lit(0.0))
    best = best_of(placed, served(rows, groups, space, "label"), space, mining, True, lots)
    listed = best.groupBy("vec_id", "label", "vec").agg(F.array_sort(F.collect_list(F.struct("rank", "found_id", "score"))).alias("best"))
    return listed.select("vec_id", "label", "vec", F.col("best.found_id").alias("ids"), F.col("best.score").alias("scores"))


def mine(embeddings: DataFrame, mining: Mining = Mining(), pivots: int | None = None, group: int = GROUP, lot_rows: int = LOT_ROWS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score for every anchor and positive."""
    table = written(prepared(embeddings, mining), "vectors")
    of_anchors = table.filter(F.col("vec_id") % mining.every == 0)
    total, anchors = table.count(), of_anchors.count()
    space = space_of(table, anchors, pivots)
    lots = -(-max(1, total) // lot_rows)
    rows = written(space.placed(table), "vector-cells")
    with_positives = written(space.placed(positives_of(of_anchors, rows, space, mining, group, lots), anchors=True), "anchors")
    score = F.filter("scores", lambda s: s >= 0)
    asked = written(dealt(with_positives.filter(F.size(score) > 0), group), "anchors-by-cell")

    def at(s: Column) -> Column:  # the distance of a score; a root of what rounding makes negative is 0
        return F.sqrt(F.greatest(F.col("length") + space.longest - 2 * s, F.lit(0.0)))

    lowest, highest = F.array_min(score) * (mining.low / mining.of), F.array_max(score) * (mining.high / mining.of)
    groups = asked.groupBy("group", "cell").agg(F.max("dist").alias("radius"), F.max(at(lowest)).alias("reach"), F.min(at(highest)).alias("nearest"))
    best = best_of(asked, served(rows, groups, space), space, mining, False, lots)
    named = best.join(asked.select("vec_id", "label", "vec", "ids", "scores"), ["vec_id", "label", "vec"])
    positive = lambda c: F.get(c, F.col("place"))
    return named.select(
        F.col("vec_id").alias("anchor_id"), positive("ids").alias("positive_id"), F.col("rank").cast("int").alias("rank"),
        F.col("found_id").alias("negative_id"), positive("scores").alias("positive_score"), F.col("score").alias("negative_score"),
    )


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(read_table(spark, sf_dir, "embeddings"))
