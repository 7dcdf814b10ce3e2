"""Readers and writers of files: JSON lines, JSON arrays, evaluation sets, registries, blobs."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def json_lines(spark: SparkSession, path: str, schema: StructType | str, strict: bool = True) -> DataFrame:
    """JSON lines; blank ones are skipped. A malformed line raises, or is left out where strict is off."""
    return spark.read.json(path, schema=schema, mode="FAILFAST" if strict else "DROPMALFORMED")


def malformed_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The lines that don't parse."""
    parsed = F.from_json("value", f"{schema}, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    lines = spark.read.text(path).filter(F.trim("value") != "")
    return lines.filter(parsed["_corrupt_record"].isNotNull()).select(F.col("value").alias("_corrupt_record"))


def line_count(spark: SparkSession, path: str) -> int:
    return spark.read.text(path).filter(F.trim("value") != "").count()


def seeds(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array whose items are ids, or objects with the id as paperId or paper_id."""
    items = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<string>")).alias("item"))
    bare = F.when(~F.trim("item").startswith("{"), F.col("item"))
    return items.select(F.coalesce(F.get_json_object("item", "$.paperId"), F.get_json_object("item", "$.paper_id"), bare).alias("paper_id"))


def with_position(rows: DataFrame, name: str = "position") -> DataFrame:
    """Numbers rows from 0, without gaps, in the order of the files that they are read from, by name, and of lines in them, however
    files are dealt to tasks (Spark deals large ones first). Rows that come from no files keep the order of partitions."""
    try:
        at = ["_file", "_block"]
        rows = rows.withColumns({"_file": F.col("_metadata.file_path"), "_block": F.col("_metadata.file_block_start")})
    except AnalysisException:
        at = ["_part"]
    numbered = rows.withColumn("_id", F.monotonically_increasing_id())
    if at == ["_part"]:
        numbered = numbered.withColumn("_part", F.shiftrightunsigned("_id", 33))
    # A block of a file is read by one task, in a row.
    counts = numbered.groupBy(*at).agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    before = Window.orderBy(*at).rowsBetween(Window.unboundedPreceding, -1)  # a row for each block
    starts = counts.select(*at, (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_start"))
    placed = numbered.join(F.broadcast(starts), at)  # one row per block
    return placed.withColumn(name, F.col("_start") + F.col("_id")).drop("_id", "_start", *at)


def evaluation_set(spark: SparkSession, inputs: str, sidecar: str | None, schema: str, sidecar_schema: str | None = None) -> DataFrame:
    """Samples and their sidecar rows, matched by position; sample_id falls back to the position."""
    rows = with_position(json_lines(spark, inputs, schema))
    if sidecar:
        rows = rows.join(with_position(json_lines(spark, sidecar, sidecar_schema)), "position", "left")
    default = F.format_string("sample_%05d", F.col("position"))
    given = F.col("sample_id") if "sample_id" in rows.columns else F.lit(None).cast("string")
    return rows.withColumn("sample_id", F.coalesce(given, default))


def ground_truth(rows: DataFrame, column: str, schema: str) -> DataFrame:
    """A JSON column that holds an object, or a string that holds one."""
    inner = F.get_json_object(F.concat(F.lit('{"v":'), F.col(column), F.lit("}")), "$.v")
    return rows.withColumn(column, F.from_json(inner, schema))


def registry(spark: SparkSession, root: str) -> DataFrame:
    """All */metadata.json under root, newest first; bad files are left out."""
    rows = spark.read.schema("version string, uri string, registered_at string, stage string, _corrupt_record string").json(f"{root}/*/metadata.json", multiLine=True)
    return rows.filter("_corrupt_record is null and version is not null").drop("_corrupt_record").orderBy(F.desc("registered_at"), "version")


def reports(spark: SparkSession, paths: dict[str, str], schema: str) -> DataFrame:
    """One JSON report per model, with its name."""
    union = None
    for name, path in paths.items():
        one = spark.read.schema(schema).json(path, multiLine=True).withColumn("model", F.lit(name))
        union = one if union is None else union.unionByName(one)
    return union


def blobs(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """name, path, length and modified of files; their bytes aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "path", "length", F.col("modificationTime").alias("modified"))


def find_files(files: DataFrame, query: str) -> DataFrame:
    return files.filter(F.contains(F.lower("name"), F.lit(query.lower()))).orderBy("name")


def missing_tables(spark: SparkSession, required: list[str]) -> list[str]:
    return sorted(set(required) - {t.name for t in spark.catalog.listTables()})


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes one small file, such as a report or a run's state, over what was there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    out.write(bytearray(text.encode()))
    out.close()


def append_new(rows: DataFrame, path: str, key: str, schema: str) -> None:
    """Appends as JSON lines the rows whose key the file lacks."""
    spark = rows.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fresh = rows.dropDuplicates([key])
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        fresh = fresh.join(json_lines(spark, path, schema).select(key), key, "left_anti")
    fresh.write.mode("append").json(path)


def write_splits(rows: DataFrame, path: str) -> None:
    rows.write.partitionBy("split").mode("overwrite").json(path)


def write_run(samples: DataFrame, aggregate: DataFrame, root: str, run_id: str) -> str:
    """Samples and aggregate of an evaluation under run_<id>; raises where there are no samples."""
    if samples.isEmpty():
        raise ValueError("no results to write")
    samples.write.json(f"{root}/run_{run_id}/samples")
    aggregate.coalesce(1).write.json(f"{root}/run_{run_id}/aggregate")
    return f"{root}/run_{run_id}"
