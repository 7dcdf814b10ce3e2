"""Upserts merged on read: a table in buckets of its key's hash, with a run of changes for each batch.

A batch writes its own rows and nothing else. A read folds the runs of a key: base rows that no change names stay where they are
read, and only named keys meet. Compaction folds the runs of the buckets whose changes have grown, bucket by bucket, and vacuum deletes
what no kept version names. A version is a small file that lists runs and their buckets; it appears by a rename, so readers
see whole versions, and of two writers of one version the second fails.

rules say how the rows of a key make one, column by column: last (the default; the row with the greatest order, or else of the
latest batch), first (of the earliest batch that has a row of the key) or sum. Rows of a batch are folded alike before they are
written, in their order. Rows without key are left out.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citemill.operators.merge import _files, _numbers

#: Changed rows up to which they are broadcast to the base.
BROADCAST_ROWS = 1 << 20


@dataclass
class KeyedTable:
    spark: SparkSession
    root: str
    schema: str
    key: str
    order: str | None = None
    rules: dict[str, str] = field(default_factory=dict)
    buckets: int = 64

    def upsert(self, rows: DataFrame, batch: int | None = None) -> None:
        """Adds the rows as one run. A batch number that the table has seen already is left out, so a stream may repeat it."""
        version, runs, seen = self._version()
        if batch is not None and batch <= seen:
            return
        number = 1 + max((r["number"] for r in runs), default=0)
        numbered = rows.filter(F.col(self.key).isNotNull()).select(*self._names(), F.lit(number).cast("long").alias("_number"))
        run = self._write(self._folded(numbered), number, base=False)
        self._commit(version + 1, [*runs, *run], seen if batch is None else batch)

    def read(self, keys: DataFrame | None = None) -> DataFrame:
        """The rows of all keys, or of a few (one column named as the key), for which only their buckets are read."""
        _, runs, _ = self._version()
        if keys is not None:
            asked = {r[0] for r in keys.select(self._bucket()).distinct().collect()}  # buckets at most
            runs = [r | {"rows": {b: n for b, n in r["rows"].items() if int(b) in asked}} for r in runs]
        found = self._merged(runs).select(*self._names())
        return found if keys is None else found.join(keys, self.key, "left_semi")

    def compact(self, ratio: float = 0.2) -> list[int]:
        """Folds the buckets whose changed rows are more than ratio of their base rows; which those were."""
        version, runs, seen = self._version()
        sizes = {True: {}, False: {}}
        for r in runs:
            for b, n in r["rows"].items():
                sizes[r["base"]][b] = sizes[r["base"]].get(b, 0) + n
        chosen = [b for b, n in sizes[False].items() if n > ratio * sizes[True].get(b, 0)]
        if chosen:
            parts = [r | {"rows": {b: n for b, n in r["rows"].items() if b in chosen}} for r in runs]
            number = max(r["number"] for r in runs)
            folded = self._write(self._merged(parts).withColumn("_number", F.lit(number).cast("long")), number, base=True)
            left = [r | {"rows": {b: n for b, n in r["rows"].items() if b not in chosen}} for r in runs]
            self._commit(version + 1, [r for r in [*left, *folded] if r["rows"]], seen)
        return sorted(map(int, chosen))

    def vacuum(self, keep: int = 1) -> int:
        """Deletes all versions but the last keep and the runs that only those name; the number of deleted runs."""
        files, path = _files(self.spark, self.root)
        numbers = _numbers(self.spark, self.root)
        kept = {r["path"] for n in numbers[-keep:] for r in self._version(n)[1]}
        for n in numbers[:-keep]:
            files.delete(path(self._pointer(n)), True)
        gone = [f.getPath() for f in files.listStatus(path(f"{self.root}/runs")) if f.getPath().getName() not in {k.rpartition("/")[2] for k in kept}]
        for folder in gone:
            files.delete(folder, True)
        return len(gone)

    def _names(self) -> list[str]:
        return [c.split()[0] for c in self.schema.split(", ")]

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _folded(self, rows: DataFrame) -> DataFrame:
        """rows with _number, the latest of the folded ones, one for each key."""
        last = F.struct(*([self.order] if self.order else []), "_number")
        make = {"last": lambda c: F.max_by(c, last), "first": lambda c: F.min_by(c, F.struct("_number", *([self.order] if self.order else []))), "sum": F.sum}
        kinds = dict(c.split() for c in self.schema.split(", "))
        # Nulls are values like others: they are wrapped, so that max_by takes them from their own row.
        value = lambda c: c if self.rules.get(c) == "sum" else F.struct(c)
        sums = [make[self.rules.get(c, "last")](value(c)).alias(c) for c in self._names() if c != self.key]
        found = rows.groupBy(self.key).agg(*sums, F.max("_number").alias("_number"))
        plain = [(F.col(c) if self.rules.get(c) == "sum" else F.col(c)[c]).cast(kinds[c]).alias(c) for c in self._names() if c != self.key]
        return found.select(self.key, *plain, "_number")

    def _merged(self, runs: list[dict]) -> DataFrame:
        """Rows of the runs with _number: base rows without changes as they are, the others folded."""
        base, changes = (self._load([r for r in runs if r["base"] == is_base]) for is_base in (True, False))
        if base is None or changes is None:
            found = base if base is not None else changes
            return self.spark.createDataFrame([], f"{self.schema}, _number long") if found is None else self._folded(found) if changes is not None else found
        few = sum(sum(r["rows"].values()) for r in runs if not r["base"]) <= BROADCAST_ROWS
        named = changes.select(self.key).distinct()
        named = F.broadcast(named) if few else named
        return base.join(named, self.key, "left_anti").unionByName(self._folded(base.join(named, self.key, "left_semi").unionByName(changes)))

    def _load(self, runs: list[dict]) -> DataFrame | None:
        found = None
        for r in runs:
            if r["rows"]:
                rows = self.spark.read.schema(f"{self.schema}, _number long").parquet(*[f"{r['path']}/bucket={b}" for b in r["rows"]])
                found = rows if found is None else found.unionByName(rows)
        return found

    def _write(self, rows: DataFrame, number: int, base: bool) -> list[dict]:
        path = f"{self.root}/runs/{uuid.uuid4().hex}"
        rows.withColumn("bucket", self._bucket()).repartition("bucket").write.partitionBy("bucket").parquet(path)
        counts = self.spark.read.schema(f"{self.schema}, bucket int").parquet(path).groupBy("bucket").count().collect()  # a row for each bucket
        return [{"path": path, "number": number, "base": base, "rows": {str(r["bucket"]): r["count"] for r in counts}}] if counts else []

    def _pointer(self, number: int) -> str:
        return f"{self.root}/CURRENT/{number:012d}"

    def _version(self, number: int | None = None) -> tuple[int, list[dict], int]:
        """A version, or the newest: its number, its runs, and the last batch number it has seen."""
        numbers = _numbers(self.spark, self.root)
        if not numbers:
            return 0, [], -1
        number = number or numbers[-1]
        found = json.loads(self.spark.read.text(self._pointer(number), wholetext=True).first()[0])
        return number, found["runs"], found["seen"]

    def _commit(self, number: int, runs: list[dict], seen: int) -> None:
        """Makes the version of that number, which must follow the one that the runs were read from."""
        files, path = _files(self.spark, self.root)
        draft, target = path(f"{self.root}/DRAFT/{uuid.uuid4().hex}"), path(self._pointer(number))
        out = files.create(draft)
        out.write(bytearray(json.dumps({"runs": runs, "seen": seen}).encode()))
        out.close()
        files.mkdirs(path(f"{self.root}/CURRENT"))
        if files.exists(target) or not files.rename(draft, target):
            raise RuntimeError(f"another writer changed {self.root}")
