"""Secret scans with an incremental blob ledger.

Texts are versions of paths. Every version is content-addressed by its SHA-256; a ledger in the shared folder holds,
for each blob and rule version, what was found. A scan takes only the pairs of blob and rule version that the ledger
lacks, appends its findings, and joins them back to all paths that hold the blob.

What a scan has to do is planned on paths and blobs alone: the set of rule versions that most blobs lack is the usual
one, and only blobs that lack another set, or that several rows hold (the smallest path is read), are exceptions. The
exceptions are joined to the texts, broadcast where they are few, so texts are scanned where they are read.

Spans are found with split() and regexp_extract_all(): the lengths of what lies between the matches and of the matches
add up to offsets in code points, in blocks, so the work grows with the matches.

Defined results: a null text counts as empty and has no spans; equal texts have one blob, scanned once (twice where rows
repeat path and text, with the same findings, which count once); an empty table gives an empty table; columns other than
path and text are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citemill.llm.common import attach, bounded, new_path, read_table, text_or_empty, written


@dataclass(frozen=True)
class Rule:
    """kind names the finding. least: code points that the match, or group if it isn't 0, must have."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The kinds every scan has, in this order. The lengths after a run of one class are in the pattern, as
#: a run that is too short holds no later match; that of an assignment is checked after matching.
BASE_RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"(?<![0-9a-f])[0-9a-f]{24,}"),
)
#: Later rule versions add kinds of public formats; base spans stay.
ADDED_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULE_VERSIONS: dict[int, tuple[Rule, ...]] = {1: BASE_RULES, 2: ADDED_RULES}
KINDS = [rule.kind for rules in RULE_VERSIONS.values() for rule in rules]
#: Sums formed in one list; exceptions of a scan that are broadcast (some 120 bytes each), beyond which they are joined.
BLOCK = 128
EXCEPTIONS = 300_000
SPAN = "array<struct<start:int,kind_no:int,end:int,kind:string>>"


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once, however often use names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running_sums(numbers: Column) -> Column:
    """The sums of an array's numbers up to each, formed in blocks of BLOCK: appending to a list copies it, so the lists
    stay short."""
    none = F.array().cast("array<int>")
    begin = F.struct(F.lit(0).alias("at"), none.alias("sums"))

    def step(acc: Column, x: Column) -> Column:
        return F.struct((acc["at"] + x).alias("at"), F.array_append(acc["sums"], acc["at"] + x).alias("sums"))

    def joined_blocks(blocks: Column) -> Column:
        ends = F.aggregate(F.transform(blocks, lambda b: F.element_at(b, -1)), begin, step)["sums"]
        before = F.concat(F.array(F.lit(0)), ends)
        return _with(before, lambda all_: F.flatten(F.zip_with(blocks, F.slice(all_, F.lit(1), F.size(blocks)), lambda b, at: F.transform(b, lambda x: x + at))))

    def in_blocks(all_: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(all_), F.lit(BLOCK))
        return F.transform(starts, lambda i: F.aggregate(F.slice(all_, i, F.lit(BLOCK)), begin, step)["sums"])

    return _with(numbers, lambda x: F.when(F.size(x) > 0, _with(in_blocks(x), joined_blocks)).otherwise(none))


def rule_spans(text: Column, rule: Rule) -> Column:
    """All spans of a rule in a text, leftmost and without overlap: array of (start, kind_no, end, kind)."""
    none = F.array().cast(SPAN)

    def span(end: Column, size: Column, part: Column) -> Column:
        found = F.struct((end - size).alias("start"), F.lit(KINDS.index(rule.kind)).alias("kind_no"), end.alias("end"), F.lit(rule.kind).alias("kind"))
        return F.when(part >= rule.least, found)

    def placed(whole: Column) -> Column:
        gaps = F.transform(F.slice(F.split(text, rule.pattern), F.lit(1), F.size(whole)), F.length)
        parts = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)), F.length) if rule.group else whole
        ends = running_sums(F.zip_with(gaps, whole, lambda a, b: a + b))
        rows = F.arrays_zip(ends.alias("end"), whole.alias("size"), parts.alias("part"))
        return F.array_compact(F.transform(rows, lambda r: span(r["end"], r["size"], r["part"])))

    sizes = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), F.length)
    return F.when(F.rlike(text, F.lit(rule.pattern)), _with(sizes, placed)).otherwise(none)


def all_spans(text: Column, rules: tuple[Rule, ...]) -> Column:
    return F.flatten(F.array(*[rule_spans(text, rule) for rule in rules]))


class BlobLedger:
    """Findings by blob and rule version, as Parquet under path; scans append to it."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or new_path(spark, "secret-ledger")

    def findings(self) -> DataFrame:
        """blob, rule_version, spans: one row for each pair that was ever scanned."""
        schema = f"blob string, rule_version int, spans {SPAN}"
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.path)

    def pending(self, paths: DataFrame, rule_versions: list[int]) -> DataFrame:
        """blob, rows, first (its smallest path) and missing, the rule versions that the ledger lacks, for each blob of paths."""
        wanted = F.array(*map(F.lit, sorted(rule_versions)))
        blobs = paths.groupBy("blob").agg(F.count("*").alias("rows"), F.min("path").alias("first"))
        seen = self.findings().select("blob", "rule_version").filter(F.col("rule_version").isin(rule_versions))
        if seen.isEmpty():
            return blobs.withColumn("missing", wanted)
        done = seen.groupBy("blob").agg(F.collect_set("rule_version").alias("done"))
        return blobs.join(done, "blob", "left").withColumn("missing", F.array_except(wanted, F.coalesce("done", F.array().cast("array<int>")))).drop("done")

    def scan(self, versions: DataFrame, path_col: str = "path", text_col: str = "text", rule_versions: dict[int, tuple[Rule, ...]] = RULE_VERSIONS, paths: DataFrame | None = None) -> DataFrame:
        """Scans what the ledger lacks of the versions' blobs; gives path, blob and spans of every version, spans
        ordered by start and kind. paths: what addressed() gave for the versions, where that is known."""
        paths = self.addressed(versions, path_col, text_col) if paths is None else paths
        pending = written(self.pending(paths, list(rule_versions)), "pending")
        usual = pending.groupBy("missing").agg(F.count("*").alias("blobs")).orderBy(F.desc("blobs"), "missing").first()
        usual = F.array(*map(F.lit, usual["missing"] if usual else [])).cast("array<int>")
        apart = written(pending.filter((F.col("rows") > 1) | (F.col("missing") != usual)).select("blob", "first", F.col("missing").alias("own")), "exceptions")
        text = text_or_empty(text_col)
        named = versions.select(F.col(path_col).alias("path"), blob_of(text).alias("blob"), text.alias("text"))
        missing = F.when(F.col("own").isNull(), usual).when(F.col("path").eqNullSafe(F.col("first")), F.col("own")).otherwise(F.array().cast("array<int>"))
        todo = named.join(bounded(apart, EXCEPTIONS), "blob", "left").withColumn("missing", missing)
        pairs = [F.when(F.array_contains("missing", v), F.struct(F.lit(v).alias("rule_version"), all_spans(F.col("text"), rules).alias("spans"))) for v, rules in rule_versions.items()]
        found = todo.filter(F.size("missing") > 0).select("blob", F.explode(F.array_compact(F.array(*pairs))).alias("pair"))
        found.select("blob", "pair.rule_version", "pair.spans").write.mode("append").parquet(self.path)
        return self.join_paths(paths, list(rule_versions))

    def addressed(self, versions: DataFrame, path_col: str = "path", text_col: str = "text") -> DataFrame:
        """path and blob of every version, written."""
        return written(versions.select(F.col(path_col).alias("path"), blob_of(text_or_empty(text_col)).alias("blob")), "paths")

    def join_paths(self, paths: DataFrame, rule_versions: list[int]) -> DataFrame:
        """The ledger's findings of these rule versions for every row of paths (path, blob)."""
        sets = self.findings().filter(F.col("rule_version").isin(rule_versions) & (F.size("spans") > 0))
        once = sets.groupBy("blob").agg(F.collect_set(F.struct("rule_version", "spans")).alias("sets"))
        spans = once.select("blob", F.array_sort(F.flatten(F.transform("sets", lambda s: s["spans"]))).alias("spans"))
        counts = paths.groupBy("blob").agg(F.count("*").alias("paths"))
        table = written(spans.join(counts, "blob"), "findings")
        rows = attach(paths, table, "blob", "paths", paths.count())
        return rows.select("path", "blob", F.coalesce("spans", F.array().cast(SPAN)).alias("spans"))


def blob_of(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op3_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule version 1 is scanned as of its time; with version 2 the same ledger takes only the pairs of that version."""
    docs, ledger = read_table(spark, sf_dir, "documents"), BlobLedger(spark)
    paths = ledger.addressed(docs, "doc_id")
    ledger.scan(docs, "doc_id", rule_versions={1: RULE_VERSIONS[1]}, paths=paths)
    found = ledger.scan(docs, "doc_id", paths=paths)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind_no"] < len(BASE_RULES))
    return found.select(F.col("path").alias("doc_id"), *[count(r.kind) for r in BASE_RULES], F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), F.col("blob"))
