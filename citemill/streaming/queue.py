"""The retry queue, a cache with expiry and the training trigger as streams."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from citemill.operators.keyed_table import KeyedTable
from citemill.operators.merge import ALERT_AFTER, RETRY_SECONDS, TIMEOUT_STEP

#: Seconds after which a cached value, or a queued paper that nothing happens to, is forgotten.
EXPIRY_SECONDS = 172_800
STATE = "fail_runs int, timeout_sec double, alerted boolean, upload_failed boolean, retry_at long, last_at long"
EVENTS = "paper_id string, event string, fail_runs int, timeout_sec double, at long"


class RetryQueue(StatefulProcessor):
    """A paper's place in the queue. Times are milliseconds of event time. Two timers: for the next retry, which falls due by
    itself once the watermark passes it, and for forgetting a paper that had no result for EXPIRY_SECONDS."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.queue = handle.getValueState("queue", STATE)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        before, out = self._entry(), []
        entry = before
        # Rows of a batch come in any order; what fell due between two of them is told first.
        for row in pd.concat(list(rows)).sort_values("at").itertuples():
            entry = self._pass_time(entry, row.at, out)
            entry = self._take(entry, row, out)
        self._store(before, entry)
        yield self._told(key, out)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        before, out = self._entry(), []
        self._store(before, self._pass_time(before, expiredTimerInfo.getExpiryTimeInMs(), out))
        yield self._told(key, out)

    def _entry(self) -> dict | None:
        names = [c.split()[0] for c in STATE.split(", ")]
        return dict(zip(names, self.queue.get())) if self.queue.exists() else None

    @staticmethod
    def _timers(entry: dict | None) -> set[int]:
        return {t for t in (entry["retry_at"], entry["last_at"] + EXPIRY_SECONDS * 1000) if t is not None} if entry else set()

    def _store(self, before: dict | None, after: dict | None) -> None:
        for t in self._timers(before) - self._timers(after):
            self.handle.deleteTimer(t)
        for t in self._timers(after) - self._timers(before):
            self.handle.registerTimer(t)
        if after:
            self.queue.update(tuple(after.values()))
        elif before:
            self.queue.clear()

    @staticmethod
    def _pass_time(entry: dict | None, now: int, out: list) -> dict | None:
        if entry and entry["retry_at"] is not None and entry["retry_at"] <= now:
            out.append(("due", entry["fail_runs"], entry["timeout_sec"], entry["retry_at"]))
            entry = entry | {"retry_at": None}
        if entry and entry["last_at"] + EXPIRY_SECONDS * 1000 <= now:
            out.append(("forgotten", entry["fail_runs"], entry["timeout_sec"], entry["last_at"] + EXPIRY_SECONDS * 1000))
            entry = None
        return entry

    @staticmethod
    def _take(entry: dict | None, row: Any, out: list) -> dict | None:
        known = entry or {"fail_runs": 0, "timeout_sec": 120.0, "alerted": False, "upload_failed": False}
        runs, seconds = known["fail_runs"], known["timeout_sec"]
        if row.status == "uploaded" or (row.code in (403, 404) and not known["upload_failed"] and row.status != "gcs_upload_failed"):
            out.append(("done" if row.status == "uploaded" else "deleted", runs, seconds, row.at))
            return None
        seconds += TIMEOUT_STEP if runs else 0
        runs, retry_at = runs + 1, row.at + RETRY_SECONDS * 1000
        out.append(("retry", runs, seconds, retry_at))
        alert = runs > ALERT_AFTER and not known["alerted"]
        if alert:
            out.append(("alert", runs, seconds, row.at))
        upload = known["upload_failed"] or row.status == "gcs_upload_failed"
        return {"fail_runs": runs, "timeout_sec": seconds, "alerted": known["alerted"] or alert, "upload_failed": upload, "retry_at": retry_at, "last_at": row.at}

    @staticmethod
    def _told(key: Any, out: list) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *x) for x in out], columns=[c.split()[0] for c in EVENTS.split(", ")])


def retry_events(results: DataFrame, late: str = "0 seconds") -> DataFrame:
    """A stream of fetch results (paper_id, ts, status, code) -> what the queue does with them, at its time: retry (planned for
    at), due (its time has come and no other result came before), one alert after five failed runs, deleted after 403 or 404
    unless an upload had failed, done, and forgotten after 48 hours without a result. State is kept for papers in the queue
    alone."""
    rows = results.withWatermark("ts", late).select("paper_id", "ts", "status", "code", F.unix_millis("ts").alias("at"))
    told = rows.groupBy("paper_id").transformWithStateInPandas(RetryQueue(), EVENTS, "append", "eventTime")
    return told.withColumn("at", F.timestamp_millis("at"))


class ReadCache(StatefulProcessor):
    """A key's cached value, which expires seconds after it was put, by a timer of event time."""

    def __init__(self, seconds: int) -> None:
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("value", "value string, until long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        held = before = self.value.get() if self.value.exists() else None
        out = []
        for row in pd.concat(list(rows)).sort_values(["at", "number"]).itertuples():
            if held and held[1] <= row.at:
                held = None
            if row.put:
                held = (row.value, row.at + self.seconds * 1000)
            else:
                out.append((key[0], row.number, held is not None, held[0] if held else None))
        if held != before:
            if before:
                self.handle.deleteTimer(before[1])
            if held:
                self.value.update(held)
                self.handle.registerTimer(held[1])
            else:
                self.value.clear()
        yield pd.DataFrame(out, columns=["key", "number", "hit", "value"])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.value.clear()
        return iter(())


def cache_reads(requests: DataFrame, seconds: int = EXPIRY_SECONDS, late: str = "0 seconds") -> DataFrame:
    """A stream of requests (key, ts, number, put, value): puts keep a value for the given seconds, others read it. One row for
    each read: key, number, hit, value. number orders requests of one time."""
    rows = requests.withWatermark("ts", late).select("key", "ts", "number", "put", "value", F.unix_millis("ts").alias("at"))
    return rows.groupBy("key").transformWithStateInPandas(ReadCache(seconds), "key string, number long, hit boolean, value string", "append", "eventTime")


def upsert_batches(results: DataFrame, table: KeyedTable, checkpoint: str) -> StreamingQuery:
    """A query that keeps the last row of each key: every batch adds a run to the table, once, also when it is repeated."""
    return results.writeStream.foreachBatch(table.upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def live(cache: DataFrame, now: Column | None = None) -> DataFrame:
    """Cache rows that haven't expired; expires_at is 48 hours after they were written."""
    return cache.filter(F.col("expires_at") > (F.current_timestamp() if now is None else now))


def with_expiry(rows: DataFrame, written_at: str = "written_at", seconds: int = EXPIRY_SECONDS) -> DataFrame:
    return rows.withColumn("expires_at", F.col(written_at) + F.make_dt_interval(secs=F.lit(seconds)))


def enough_new(total: int, trained: int, least: int = 50) -> bool:
    """The training trigger."""
    return total - trained >= least


def training_runs(daily: DataFrame, least: int = 50) -> DataFrame:
    """daily (day, n) with total, the samples so far, and trained, whether that day's check starts a training: enough samples are
    new since the last one. One row a day, so the days are walked in one array."""
    days = daily.agg(F.array_sort(F.collect_list(F.struct("day", "n"))).alias("days"))
    start = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("last"), F.expr("cast(array() as array<struct<day: date, total: bigint, trained: boolean>>)").alias("runs"))

    def step(state: Column, day: Column) -> Column:
        total = state["total"] + day["n"]
        enough = total - state["last"] >= least
        run = F.struct(day["day"].alias("day"), total.alias("total"), enough.alias("trained"))
        return F.struct(total.alias("total"), F.when(enough, total).otherwise(state["last"]).alias("last"), F.concat(state["runs"], F.array(run)).alias("runs"))

    return days.select(F.explode(F.aggregate("days", start, step)["runs"]).alias("r")).select("r.*")
