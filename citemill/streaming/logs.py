"""Log shipping: tail NDJSON, join multiline records, route to daily folders, count by window."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from citemill.functions.text import log_line

LOG_SCHEMA = "ts timestamp, level string, logger string, message string, module string, function string, line int, application string, dag_id string, task_id string, run_id string, paper_id string, seed_id string, depth int"


def parsed(lines: DataFrame) -> DataFrame:
    """value (one JSON object) -> its keys as columns; a bad line keeps its text as message, with error."""
    row = F.from_json("value", LOG_SCHEMA + ", _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"})
    rows = lines.filter(F.trim("value") != "").withColumn("r", row)
    bad = F.col("r._corrupt_record").isNotNull()
    names = [c.split()[0] for c in LOG_SCHEMA.split(", ")]
    return rows.select(*[F.when(bad, F.col("value")).otherwise(F.col("r.message")).alias("message") if n == "message" else F.col(f"r.{n}").alias(n) for n in names], F.when(bad, "json").alias("error"))


def tail(spark: SparkSession, folder: str) -> DataFrame:
    return parsed(spark.readStream.text(folder))


BEGINS = r"^\[20\d\d"
#: Lines of a file that one task looks at together.
LOT_LINES = 100_000
#: Seconds after which a record that no line follows is passed on as it is.
FLUSH_SECONDS = 5


def multiline(lines: DataFrame, file: str = "file", number: str = "line_no", begins: str = BEGINS, lot_lines: int = LOT_LINES) -> DataFrame:
    """Lines that don't begin a record belong to the one before: file, line_no (of the first), record. Lines before the first
    record of a file are a record of their own; a null line is an empty one. line_no orders the lines of a file and may have gaps.

    A file is cut in lots of line numbers. Each lot finds the records that begin in it, and the record that is open at its end
    is carried on to the lots behind, over one row a lot; so a task holds the lines of a lot, or of one record."""
    start = F.when(F.rlike("value", F.lit(begins)), F.col(number))
    marked = lines.withColumns({"_lot": F.floor(F.col(number) / lot_lines), "_begins": start})
    ends = marked.groupBy(file, "_lot").agg(F.max("_begins").alias("_last"))
    before = Window.partitionBy(file).orderBy("_lot").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(F.col(file).alias("_of_file"), F.col("_lot").alias("_of_lot"), F.last("_last", ignorenulls=True).over(before).alias("_carried"))
    inside = F.last("_begins", ignorenulls=True).over(Window.partitionBy(file, "_lot").orderBy(number))
    same = F.col(file).eqNullSafe(F.col("_of_file")) & F.col("_lot").eqNullSafe(F.col("_of_lot"))
    placed = marked.withColumn("_inside", inside).join(carried, same).withColumn("_start", F.coalesce("_inside", "_carried"))
    parts = placed.groupBy(file, "_start").agg(F.min(number).alias(number), F.array_sort(F.collect_list(F.struct(number, F.coalesce("value", F.lit("")).alias("value")))).alias("parts"))
    return parts.select(file, number, F.array_join(F.transform("parts", lambda p: p["value"]), "\n").alias("record"))


class LineJoiner(StatefulProcessor):
    """The open record of a file, as a list of its lines, which a line that begins the next record or a timer closes."""

    def __init__(self, seconds: int) -> None:
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lines = handle.getListState("lines", "value string")
        self.open = handle.getValueState("open", "line_no long, flush_at long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        out, parts, was = [], None, self.open.get() if self.open.exists() else None
        head, flush_at = was if was else (None, None)
        for row in pd.concat(list(rows)).sort_values("line_no").itertuples():
            timed_out = flush_at is not None and flush_at <= row.at
            if head is not None and (row.begins or timed_out):
                out.append(self._record(key, head, self._kept() if parts is None else parts))
                head, parts = None, []
            if head is None:
                head, parts = row.line_no, []
            elif parts is None:
                parts = self._kept()
            parts.append(row.value)
            flush_at = row.at + self.seconds * 1000
        if was:
            self.handle.deleteTimer(was[1])
        self.lines.put([(p,) for p in parts])
        self.open.update((head, flush_at))
        self.handle.registerTimer(flush_at)
        yield self._told(out)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        head, parts = self.open.get()[0], self._kept()
        self.lines.clear()
        self.open.clear()
        yield self._told([self._record(key, head, parts)])

    def _kept(self) -> list[str]:
        return [x[0] for x in self.lines.get()]

    @staticmethod
    def _record(key: Any, head: int, parts: list[str]) -> tuple:
        return key[0], head, "\n".join(parts)

    @staticmethod
    def _told(out: list) -> pd.DataFrame:
        return pd.DataFrame(out, columns=["file", "line_no", "record"])


def multiline_stream(lines: DataFrame, begins: str = BEGINS, seconds: int = FLUSH_SECONDS, late: str = "0 seconds") -> DataFrame:
    """multiline() of a stream of lines (file, ts, line_no, value), ts the time when a line was read: a record is passed on when the
    next one begins, or when no line has followed for the given seconds. Batches give a file's lines in order."""
    rows = lines.withWatermark("ts", late).select("file", "ts", "line_no", F.coalesce("value", F.lit("")).alias("value"), F.unix_millis("ts").alias("at"), F.coalesce(F.rlike("value", F.lit(begins)), F.lit(False)).alias("begins"))
    return rows.groupBy("file").transformWithStateInPandas(LineJoiner(seconds), "file string, line_no long, record string", "append", "eventTime")


def dissected(records: DataFrame, column: str = "record") -> DataFrame:
    return records.withColumn("log", log_line(F.col(column))).select("*", "log.*").drop("log")


def route(rows: DataFrame, path: str, checkpoint: str, kind: Column, ts: str = "ts"):
    """A query that writes each row to the folder of its kind and day, also late ones to the day they belong to."""
    placed = rows.withColumns({"log_type": kind, "day": F.to_date(ts)})
    return placed.writeStream.format("json").partitionBy("log_type", "day").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts(rows: DataFrame, by: str, ts: str = "ts", width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Rows by window and value, with a watermark."""
    return rows.withWatermark(ts, late).groupBy(F.window(ts, width), by).agg(F.count("*").alias("n"))
