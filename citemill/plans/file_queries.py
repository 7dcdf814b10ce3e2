"""Registered queries of readers, sinks and record functions: files are made from the test tables, read back and compared."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from citemill.functions import ids, parsing, text
from citemill.operators import merge, serving, traverse
from citemill.plans.queries import query
from citemill.sources import readers
from citemill.sources.storage import new_path

PAPER = "paper_id string, citation_count long"


def _lines(read, line, name: str):
    """The path of a file with a line for each paper."""
    papers = read("papers")
    path = new_path(papers.sparkSession, name)
    papers.select(F.explode(line).alias("value")).write.text(path)
    return papers.sparkSession, path


def _json(*columns: str):
    return F.to_json(F.struct(*columns))


@query("SELECT paper_id, citation_count FROM papers", "papers")
def s08_json_lines(read):
    spark, path = _lines(read, F.array(_json("paper_id", "citation_count"), F.lit("")), "lines")
    return readers.json_lines(spark, path, PAPER)


@query("SELECT paper_id, citation_count FROM papers WHERE pos % 7 <> 0", "papers")
def s09_malformed_lines_skipped(read):
    spark, path = _lines(read, F.array(F.when(F.col("pos") % 7 == 0, F.lit('{"paper_id": ')).otherwise(_json("paper_id", "citation_count"))), "lines")
    return readers.json_lines(spark, path, PAPER, strict=False)


@query("SELECT count(*) AS lines FROM papers", "papers")
def s10_line_count(read):
    spark, path = _lines(read, F.array(_json("paper_id"), F.lit("  ")), "lines")
    return spark.range(1).select(F.lit(readers.line_count(spark, path)).cast("long").alias("lines"))


@query("SELECT n_name AS paper_id FROM nation")
def s11_seeds(read):
    rows, n = read("nation"), F.col("n_nationkey") % 3
    named = lambda key: F.to_json(F.struct(F.col("n_name").alias(key)))
    item = F.when(n == 0, F.concat(F.lit('"'), "n_name", F.lit('"'))).when(n == 1, named("paperId")).otherwise(named("paper_id"))
    path = new_path(rows.sparkSession, "seeds")
    rows.agg(F.concat(F.lit("["), F.array_join(F.collect_list(item), ", "), F.lit("]")).alias("value")).write.text(path)
    return readers.seeds(rows.sparkSession, path)


@query("SELECT conv_id, turn, text AS t FROM conversations")
def s13_ground_truth(read):
    given = _json(F.col("text").alias("t"))
    quoted = F.regexp_extract(F.to_json(F.struct(given.alias("x"))), r"(?s)^\{\"x\":(.*)\}$", 1)
    rows = read("conversations").select("conv_id", "turn", F.when(F.col("turn") % 2 == 0, given).otherwise(quoted).alias("truth"))
    return readers.ground_truth(rows, "truth", "t string").select("conv_id", "turn", "truth.t")


@query("SELECT n_name || '.json' AS name, length('{\"version\": \"' || n_name || '\"}') AS length FROM nation")
def s17_s18_blobs(read):
    rows = read("nation")
    spark, path = rows.sparkSession, new_path(rows.sparkSession, "blobs")
    for r in rows.select("n_name").toLocalIterator():  # 25 nations
        readers.put_text(spark, f"{path}/deep/{r.n_name}.json", json.dumps({"version": r.n_name}))
        readers.put_text(spark, f"{path}/{r.n_name}.txt", "x")
    return readers.blobs(spark, path, "*.json").select("name", "length")


@query("SELECT n_name AS version, 'uri-' || n_nationkey AS uri, 'staging' AS stage FROM nation WHERE n_nationkey % 5 <> 0")
def s19_registry(read):
    rows = read("nation")
    spark, path = rows.sparkSession, new_path(rows.sparkSession, "registry")
    for r in rows.select("n_name", "n_nationkey").toLocalIterator():  # 25 nations
        good = json.dumps({"version": r.n_name, "uri": f"uri-{r.n_nationkey}", "registered_at": f"2026-01-{r.n_nationkey + 1:02d}", "stage": "staging"}, indent=1)
        readers.put_text(spark, f"{path}/{r.n_name}/metadata.json", good if r.n_nationkey % 5 else good[:20])
    return readers.registry(spark, path).select("version", "uri", "stage")


@query("SELECT 'm' || n_nationkey AS model, n_regionkey + 0.5::double AS soft FROM nation")
def s20_k15_reports(read):
    rows = read("nation")
    spark, path = rows.sparkSession, new_path(rows.sparkSession, "reports")
    paths = {}
    for r in rows.toLocalIterator():  # 25 nations
        paths[f"m{r.n_nationkey}"] = f"{path}/m{r.n_nationkey}/report.json"
        readers.put_text(spark, paths[f"m{r.n_nationkey}"], json.dumps({"soft": r.n_regionkey + 0.5}))
    return readers.reports(spark, paths, "soft double").select("model", "soft")


@query("SELECT paper_id, title FROM papers", "papers")
def k12_append_new(read):
    rows = read("papers").select("paper_id", "title", "pos")
    path = new_path(rows.sparkSession, "examples")
    for some in (rows.filter("pos % 3 = 0"), rows, rows):
        readers.append_new(some.select("paper_id", "title"), path, "paper_id", "paper_id string, title string")
    return readers.json_lines(rows.sparkSession, path, "paper_id string, title string")


@query("SELECT paper_id, CASE WHEN pos % 10 < 8 THEN 'train' WHEN pos % 10 = 8 THEN 'val' ELSE 'test' END AS split FROM papers", "papers")
def k14_split_files(read):
    rows, n = read("papers"), F.col("pos") % 10
    path = new_path(rows.sparkSession, "splits")
    readers.write_splits(rows.select("paper_id", F.when(n < 8, "train").when(n == 8, "val").otherwise("test").alias("split")), path)
    return rows.sparkSession.read.schema("paper_id string, split string").json(path)


@query("SELECT doc_id AS sample_id, doc_id % 3 = 0 AS exact FROM documents")
def k24_evaluation_run(read):
    rows = read("documents").select(F.col("doc_id").alias("sample_id"), (F.col("doc_id") % 3 == 0).alias("exact"))
    path = readers.write_run(rows, rows.agg(F.avg(F.col("exact").cast("int")).alias("mean")), new_path(rows.sparkSession, "runs"), "1")
    return rows.sparkSession.read.schema("sample_id long, exact boolean").json(f"{path}/samples")


@query("SELECT 'papers' AS name, count(*) AS n FROM papers UNION ALL SELECT 'refs', count(*) FROM refs UNION ALL SELECT 'cits', count(*) FROM cits", "papers", "refs", "cits")
def k06_transactional_write(read):
    names = ("papers", "refs", "cits")
    spark = read("papers").sparkSession
    root = new_path(spark, "tables")
    merge.swap(spark, {n: read(n).orderBy(read(n).columns[0]).limit(3) for n in names}, root)
    merge.swap(spark, {n: read(n) for n in names}, root)
    found = None
    for n in names:
        one = merge.current(spark, root, n).agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n")
        found = one if found is None else found.unionByName(one)
    return found


@query("SELECT paper_id, CASE WHEN pos % 2 = 0 AND pos % 4 <> 0 THEN 'old' || paper_id ELSE 'new' || paper_id END AS arxiv_id, 'full_text' AS source_type FROM papers", "papers")
def k07_serving_papers(read):
    rows = read("papers")
    old = rows.filter("pos % 2 = 0").select("paper_id", F.when(F.col("pos") % 4 != 0, F.concat(F.lit("old"), "paper_id")).alias("arxiv_id"), F.lit("abstract").alias("source_type"))
    new = rows.select("paper_id", F.concat(F.lit("new"), "paper_id").alias("arxiv_id"), F.lit("full_text").alias("source_type"))
    return serving.save_papers(old, new.union(new))


@query(
    """
    SELECT paper_id, 'references' AS fetch_type, CAST(coalesce(n, 0) AS int) AS result_count
    FROM papers LEFT JOIN (SELECT from_id AS paper_id, count(*) AS n FROM refs JOIN papers p ON p.paper_id = to_id GROUP BY from_id) USING (paper_id)
    """,
    "papers",
    "refs",
)
def k08_fetch_log(read):
    papers = read("papers").select("paper_id", "title", "year", "citation_count")
    far = papers.withColumnRenamed("paper_id", "to_id")
    fetched = read("refs").select("from_id", "to_id", "is_influential").join(far, "to_id").withColumn("other_id", F.col("to_id"))
    edges = fetched.select("from_id", "to_id", "is_influential").limit(0)
    requests = papers.select("paper_id", F.lit("references").alias("fetch_type"), F.lit(None).cast("int").alias("year_start"), F.lit(None).cast("int").alias("year_end"))
    log = requests.withColumn("result_count", F.lit(-1)).orderBy("paper_id").limit(5)
    return serving.save_fetch(papers.orderBy("paper_id").limit(10), edges, log, fetched, requests, ["from_id", "to_id"])[2].select("paper_id", "fetch_type", "result_count")


@query("SELECT paper_id, 'c' || paper_id AS what_was_improved FROM papers WHERE pos % 3 <> 0 AND pos % 2 = 0", "papers")
def k09_analysis_bundle(read):
    rows = read("papers")
    comparison = F.when(F.col("pos") % 2 == 0, F.struct(F.concat(F.lit("c"), "paper_id").alias("what_was_improved")))
    bundle = rows.select(
        "paper_id", F.lit("p").alias("predecessor_id"), (F.col("pos") % 3 == 0).alias("is_foundational"), F.struct(F.lit("a").alias("core_method")).alias("analysis"), comparison.alias("comparison"),
        F.array(F.struct(F.lit("i").alias("influence_id"))).alias("influences"),
    )
    return serving.split_analysis(bundle)["comparison"]


@query(
    """
    SELECT event_id, CASE WHEN user_id % 3 = 0 THEN 'download_failed' ELSE event_type END AS status,
           substr(CASE WHEN user_id % 2 = 0 THEN 'Timeout after ' || user_id WHEN user_id % 3 = 0 THEN 'download_failed' ELSE event_type END, 1, 64) AS reason,
           CASE WHEN user_id % 2 = 0 THEN 140.0::double ELSE 120.0::double END AS timeout_sec
    FROM events
    """
)
def p25_failure_rows(read):
    rows = read("events").select("event_id", F.when(F.col("user_id") % 3 != 0, F.col("event_type")).alias("status"), F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("Timeout after "), "user_id")).otherwise("").alias("error"))
    return merge.failure_rows(rows).select("event_id", "status", "reason", "timeout_sec")


@query(
    """
    SELECT conv_id, turn, text, text IS NULL AS lacks_text, CASE turn % 4 WHEN 1 THEN '[1,2]' WHEN 3 THEN '{"n":' || conv_id || '}' END AS a,
           CASE WHEN turn % 4 = 2 THEN '[1,{"b":2}]' END AS rest, false AS failed
    FROM conversations
    """
)
def x17_x18_model_output(read):
    """Outputs with cited numbers, braces and a fence with a trailing comma, with missing commas, cut off before the brackets are
    closed, and with a brace in the prose before an object without a fence."""
    value = F.regexp_extract(F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("x"))), r"(?s)^\{\"x\":(.*)\}$", 1)
    fenced = F.concat(F.lit('As [1] and {x} say, here it is:\n```json\n{"t": '), value, F.lit(",}\n```\nDone [2]."))
    uncommaed = F.concat(F.lit('```\n{"a": [1 2]\n"t": '), value, F.lit("}\n```"))
    cut_off = F.concat(F.lit('Per [3]: {"t": '), value, F.lit(', "rest": [1, {"b": 2'))
    braced = F.concat(F.lit('By {y}: {"t": '), value, F.lit(' "a": {"n": '), F.col("conv_id").cast("string"), F.lit("}} [4]"))
    raw = F.when(F.col("turn") % 4 == 0, fenced).when(F.col("turn") % 4 == 1, uncommaed).when(F.col("turn") % 4 == 2, cut_off).otherwise(braced)
    rows = read("conversations").select("conv_id", "turn", F.col("text").isNull().alias("lacks_text"), parsing.parse_output(raw).alias("p"))
    found = F.from_json("p.parsed", "t string, a string, rest string")
    return rows.select("conv_id", "turn", F.when(~F.col("lacks_text"), found["t"]).alias("text"), "lacks_text", found["a"].alias("a"), found["rest"].alias("rest"), F.col("p.error").isNotNull().alias("failed"))


@query("SELECT paper_id, CASE WHEN pos % 2 = 0 THEN 'a' || pos ELSE sha256(paper_id || '|' || pos || '|' || coalesce(title, '')) END AS author_id FROM papers", "papers")
def x24_author_id(read):
    given = F.when(F.col("pos") % 2 == 0, F.concat(F.lit("a"), "pos")).otherwise("")
    return read("papers").select("paper_id", ids.author_id(given, F.col("paper_id"), F.col("pos"), F.col("title")).alias("author_id"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y') || '_' || strftime(o_orderdate, '%m') || '_ARXIV_' || o_orderkey || '.pdf' AS file_name, 'ARXIV_' || o_orderkey || '_' || strftime(o_orderdate, '%Y%m%d000000') AS tree FROM orders")
def x25_x32_names(read):
    paper = F.concat(F.lit("ARXIV:"), "o_orderkey")
    day = F.col("o_orderdate").cast("date")
    return read("orders").select("o_orderkey", ids.pdf_name(paper, day.cast("string")).alias("file_name"), ids.tree_id(paper, day.cast("timestamp")).alias("tree"))


@query("SELECT doc_id, doc_id % 2 = 0 AND strlen(text) >= 1019 AS is_pdf FROM documents WHERE text IS NOT NULL")
def x26_pdf_magic(read):
    content = F.concat(F.when(F.col("doc_id") % 2 == 0, F.lit("%PDF-")).otherwise(F.lit("<html")), "text").cast("binary")
    return read("documents").filter("text is not null").select("doc_id", ids.is_pdf(content).alias("is_pdf"))


@query("SELECT paper_id, pos % 3 = 0 AS has_rows FROM papers", "papers")
def g18_fetch_status(read):
    rows = read("papers").select("paper_id", "pos")
    log = rows.filter("pos % 3 = 0 or pos % 5 = 0").select("paper_id", F.lit("citations").alias("fetch_type"), F.when(F.col("pos") % 3 == 0, 2000).otherwise(1999).alias("year_start"), F.lit(2003).alias("year_end"))
    return traverse.fetched(rows, log, "citations", (2000, 2003)).select("paper_id", "has_rows")


@query(
    r"""
    SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g'), '^ | $', '', 'g'), '[\x00-\x1f\x7f-\x{9f}]', '', 'g') AS name
    FROM conversations
    """
)
def x03_author_names(read):
    authors = F.array(F.struct(F.lit("1").alias("id"), F.col("text").alias("name")))
    return read("conversations").select("conv_id", "turn", F.get(text.clean_authors(authors), 0)["name"].alias("name"))
