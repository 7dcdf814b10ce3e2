"""Written intermediate tables: they cut lineage and outlive executors."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which all executors share. Where it is unset: in local runs a folder of our own; on a cluster an
    error, as no folder of one machine would do."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = tempfile.mkdtemp(prefix="citemill-")
            spark.sparkContext.setCheckpointDir(_own[app])
        folder = _own[app]
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, options: dict[str, str] | None = None, path: str | None = None) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back.

    This cuts the lineage with files that outlive executors, so a lost one costs no recomputation.
    """
    path = path or new_path(df.sparkSession, name)
    df.write.options(**(options or {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes the files behind tables made by written(), when no later step reads them."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def let_shuffles_go(spark: SparkSession) -> None:
    """Has Spark delete the shuffle files of plans that nothing refers to any more, which it else does when the driver happens to
    collect its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def numbered(rows: DataFrame, by: str, number: str = "number", of: str | None = None) -> DataFrame:
    """rows, one for each value of by, with their numbers from 0 in the order of by; of names a boolean column whose true
    rows alone are counted (others get the number of the next). Rows are sorted in ranges, numbered in each, and the
    counts of earlier ranges added, so no task sees more than a range."""
    counted = F.col(of).cast("long") if of else F.lit(1).cast("long")
    dealt = written(rows.repartitionByRange(by).withColumns({"_part": F.spark_partition_id(), "_one": counted}), "numbered")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    parts = dealt.groupBy("_part").agg(F.sum("_one").alias("_ones"))
    starts = parts.select("_part", F.coalesce(F.sum("_ones").over(before), F.lit(0)).alias("_start"))
    inside = F.coalesce(F.sum("_one").over(Window.partitionBy("_part").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return dealt.withColumn("_inside", inside).join(F.broadcast(starts), "_part").withColumn(number, F.col("_start") + F.col("_inside")).drop("_part", "_one", "_inside", "_start")


def numbered_in(rows: DataFrame, group: str, lot: str, order: list, number: str = "number") -> DataFrame:
    """rows with their numbers from 0 in their group, ordered by lot and, inside it, by order. Lots are numbered each on its
    own and the counts of earlier lots added, so a large group is many tasks."""
    sizes = rows.groupBy(group, lot).agg(F.count("*").alias("_rows"))
    before = Window.partitionBy(group).orderBy(lot).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col(group).alias("_of_group"), F.col(lot).alias("_of_lot"), F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy(group, lot).orderBy(*order)) - 1
    same = F.col(group).eqNullSafe(F.col("_of_group")) & F.col(lot).eqNullSafe(F.col("_of_lot"))
    return rows.withColumn("_inside", inside).join(starts, same).withColumn(number, (F.col("_start") + F.col("_inside"))).drop("_of_group", "_of_lot", "_start", "_inside")
