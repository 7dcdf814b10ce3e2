"""Running queries with state: timers, expiry and the state store they need."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from citemill.sources.storage import new_path

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: State with timers and lists lives in RocksDB, on disk, with its changes in the checkpoint folder.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_available(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Takes what is there through a query with state, into Parquet files at path. Another call with the same checkpoint goes on
    from there."""
    spark = rows.sparkSession
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        query = rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    return query


def replay(rows: DataFrame, ts: str, query: Callable[[DataFrame], DataFrame], parts: int = 3) -> DataFrame:
    """What a query with state makes of rows that arrive in parts stretches of time: files are added and the query goes on
    from its checkpoint, part by part. Inside a stretch rows are in any order."""
    spark, rows = rows.sparkSession, rows.withColumn(ts, F.col(ts).cast("timestamp"))
    source, out, checkpoint = (new_path(spark, name) for name in ("replayed", "replay-out", "replay-checkpoint"))
    bounds = rows.agg(F.min(ts).alias("low"), F.max(ts).alias("high")).first()
    for part in range(parts if bounds.low is not None else 1):
        inside = F.lit(True)
        if bounds.low is not None:
            step = (bounds.high - bounds.low) / parts
            inside = (F.col(ts) >= bounds.low + part * step) & (F.lit(part == parts - 1) | (F.col(ts) < bounds.low + (part + 1) * step))
        rows.filter(inside).write.mode("append").parquet(source)
        found = query(spark.readStream.schema(rows.schema).parquet(source))
        run_available(found, out, checkpoint)
    return spark.read.schema(found.schema).parquet(out)
