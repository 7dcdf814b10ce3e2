"""Upserts and deletes as joins of the stored table with the changes; the caller writes the result to a new path.

Parquet has no MERGE, so merge results are whole tables, and swap() replaces a set of tables together.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RETRY_SECONDS = 30
TIMEOUT_STEP = 20
ALERT_AFTER = 5


def merge(old: DataFrame, new: DataFrame, keys: list[str], change: dict[str, Column]) -> DataFrame:
    """old with new merged in by keys. change: for rows in both, columns' values by expressions of o.* and n.*; other
    columns stay as they are. new has one row per key."""
    has_old, has_new = F.col("o._side").isNotNull(), F.col("n._side").isNotNull()
    same = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
    both = old.withColumn("_side", F.lit(1)).alias("o").join(new.withColumn("_side", F.lit(1)).alias("n"), same, "full_outer")
    columns = []
    for name in old.columns:
        added = F.col(f"n.{name}") if name in new.columns else F.lit(None)
        updated = change.get(name, F.col(f"o.{name}"))
        columns.append(F.when(has_old & has_new, updated).when(has_old, F.col(f"o.{name}")).otherwise(added).alias(name))
    return both.select(*columns)


def insert_new(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old and the rows of new (one per key) whose key it lacks."""
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti").select(*old.columns))


def delete(old: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return old.join(gone.select(*keys), keys, "left_anti")


def upsert_papers(old: DataFrame, new: DataFrame) -> DataFrame:
    """Known papers count the query once for each row of new and take its last three counts; others are added."""
    counts = ["citation_count", "influential_count", "reference_count"]
    rest = [c for c in new.columns if c not in ("paper_id", "pos")]
    order = F.col("pos") if "pos" in new.columns else F.lit(0)
    batch = new.groupBy("paper_id").agg(F.max_by(F.struct(*counts), order).alias("last"), F.min_by(F.struct(*rest), order).alias("first"), F.count("*").alias("times"))
    batch = batch.select("paper_id", *[F.col(f"last.{c}").alias(c) for c in counts], *[F.col(f"first.{c}").alias(c) for c in rest if c not in counts and c != "query_count"], F.col("times").cast("int").alias("query_count"))
    return merge(old, batch, ["paper_id"], {c: F.col(f"n.{c}") for c in counts} | {"query_count": F.col("o.query_count") + F.col("n.query_count")})


def upsert_citations(old: DataFrame, new: DataFrame) -> DataFrame:
    """The four edge columns are overwritten; the timestamp of a known edge stays."""
    return merge(old, new, ["from_id", "to_id"], {c: F.col(f"n.{c}") for c in ("is_influential", "contexts", "intents", "direction") if c in new.columns})


def upsert_serving_papers(old: DataFrame, new: DataFrame) -> DataFrame:
    """New papers are added; known ones get a missing arXiv id and the new source type."""
    return merge(old, new, ["paper_id"], {"arxiv_id": F.coalesce("o.arxiv_id", "n.arxiv_id"), "source_type": F.col("n.source_type")})


def upsert_failures(old: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """A failure adds a run and waits; a failure row that is new starts at one run."""
    later = now + F.expr(f"interval {RETRY_SECONDS} seconds")
    fresh = new.withColumns({"fail_runs": F.lit(1), "retry_after": later, "last_attempt_at": now, "alerted": F.lit(False)})
    change = {c: F.col(f"n.{c}") for c in ("status", "fetch_url", "reason", "retry_after", "last_attempt_at")}
    return merge(old, fresh, ["paper_id"], change | {"fail_runs": F.col("o.fail_runs") + 1})


def after_retry(queue: DataFrame, results: DataFrame, now: Column) -> DataFrame:
    """The queue after a round: results (paper_id, status, code, error). Successes go; 403 and 404 go, except where
    the upload had failed; others count a run, wait, and get more time."""
    joined = queue.alias("q").join(results.alias("r"), "paper_id", "left")
    gone = (F.col("r.status") == "uploaded") | (F.col("r.code").isin(403, 404) & (F.col("q.status") != "gcs_upload_failed"))
    failed = F.col("r.status").isNotNull()
    change = {
        "fail_runs": F.col("q.fail_runs") + 1,
        "timeout_sec": F.col("q.timeout_sec") + TIMEOUT_STEP,
        "retry_after": now + F.expr(f"interval {RETRY_SECONDS} seconds"),
        "last_attempt_at": now,
        "reason": F.substring(F.coalesce("r.error", "r.status"), 1, 64),
    }
    kept = joined.filter(~F.coalesce(gone, F.lit(False)))
    return kept.select(*[F.when(failed, change[c]).otherwise(F.col(f"q.{c}")).alias(c) if c in change else (F.col(c) if c == "paper_id" else F.col(f"q.{c}")) for c in queue.columns])


def eligible_for_retry(queue: DataFrame, now: Column) -> DataFrame:
    ready = (F.col("retry_after").isNull() | (F.col("retry_after") <= now)) & ~F.col("alerted")
    return queue.filter(ready).orderBy(F.asc_nulls_last("last_attempt_at"), "paper_id")


def alert_pending(queue: DataFrame) -> DataFrame:
    return queue.filter((F.col("fail_runs") > ALERT_AFTER) & ~F.col("alerted"))


def mark_alerted(queue: DataFrame) -> DataFrame:
    return queue.withColumn("alerted", F.col("alerted") | (F.col("fail_runs") > ALERT_AFTER))


def failure_rows(results: DataFrame) -> DataFrame:
    """Rows for the retry queue: default status, more time after a timeout, a reason of at most 64 characters."""
    status = F.coalesce(F.nullif(F.col("status"), F.lit("")), F.lit("download_failed"))
    reason = F.substring(F.coalesce(F.nullif(F.col("error"), F.lit("")), status), 1, 64)
    timeout = F.when(F.lower(reason).contains("timeout"), 140.0).otherwise(120.0)
    return results.withColumns({"status": status, "reason": reason, "timeout_sec": timeout})


def swap(spark: SparkSession, tables: dict[str, DataFrame], root: str) -> str:
    """Writes all tables under a new version folder and, when all are there, renames a file that names it to the next
    number in the folder CURRENT. A rename is atomic and older numbers stay, so a reader always finds one whole version; of
    two writers that take the same number the second fails."""
    version = f"{root}/v-{uuid.uuid4().hex}"
    for name, rows in tables.items():
        rows.write.parquet(f"{version}/{name}")
    files, path = _files(spark, root)
    last = _numbers(spark, root)
    draft, target = path(f"{version}/POINTER"), path(f"{root}/CURRENT/{(last[-1] if last else 0) + 1:012d}")
    out = files.create(draft)
    out.write(bytearray(version.encode()))
    out.close()
    files.mkdirs(path(f"{root}/CURRENT"))
    if files.exists(target) or not files.rename(draft, target):
        raise RuntimeError(f"another writer swapped tables in {root}")
    return version


def _files(spark: SparkSession, root: str):
    """The file system of a folder, and the class of its paths."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path(root).getFileSystem(spark._jsc.hadoopConfiguration()), path


def _numbers(spark: SparkSession, root: str) -> list[int]:
    files, path = _files(spark, root)
    folder = path(f"{root}/CURRENT")
    return sorted(int(f.getPath().getName()) for f in files.listStatus(folder)) if files.exists(folder) else []


def current(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table of the newest version."""
    pointer = f"{root}/CURRENT/{_numbers(spark, root)[-1]:012d}"
    return spark.read.parquet(f"{spark.read.text(pointer).first()[0]}/{name}")
