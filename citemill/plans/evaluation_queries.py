"""Registered queries of requests, answers, judges and reports, derived from the test tables, with SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from citemill.functions import ids, text
from citemill.operators import evaluate, serving, training, validate
from citemill.plans.queries import query
from citemill.sources.readers import put_text
from citemill.sources.storage import new_path

# Requests and payloads


@query(
    """
    SELECT event_id, CASE WHEN coalesce(nullif(d, 0), 3) > 9 THEN NULL ELSE coalesce(nullif(d, 0), 3) END AS depth,
           CASE WHEN trim(p) = '' THEN 'paper_id is empty' WHEN coalesce(nullif(d, 0), 3) NOT BETWEEN 1 AND 5 THEN 'max_depth is from 1 to 5'
                WHEN event_type NOT IN ('view', 'click') THEN 'direction is backward, forward or both' END AS error
    FROM (SELECT *, CASE WHEN user_id % 11 = 0 THEN '  ' ELSE CAST(user_id AS varchar(20)) END AS p, CAST(CASE WHEN event_id % 9 < 8 THEN event_id % 9 - 1 END AS int) AS d FROM events)
    """
)
def p12_request_errors(read):
    paper = F.when(F.col("user_id") % 11 == 0, "  ").otherwise(F.col("user_id").cast("string"))
    depth = F.when(F.col("event_id") % 9 < 8, F.col("event_id") % 9 - 1).cast("int")
    direction = F.when(F.col("event_type") == "view", "backward").when(F.col("event_type") == "click", "both").when(F.col("event_type") != "error", F.col("event_type"))
    return read("events").select("event_id", validate.used_depth(depth).alias("depth"), validate.request_errors(paper, depth, direction).alias("error"))


@query(
    """
    SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'missing references' WHEN 1 THEN 'missing papers, target_paper_id' WHEN 2 THEN 'no papers' WHEN 3 THEN NULL
           ELSE 'missing citations, papers, references, target_paper_id' END AS error FROM orders
    """
)
def p41_payload_errors(read):
    papers = F.array(F.struct(F.col("o_custkey").alias("paper_id")))
    none = F.array().cast("array<struct<paper_id:bigint>>")
    rest = [none.alias("references"), none.alias("citations")]
    target = F.lit("t").alias("target_paper_id")
    made = [[target, papers.alias("papers"), rest[1]], rest, [target, none.alias("papers"), *rest], [target, papers.alias("papers"), *rest]]
    payload = F.lit("not json")
    for n, parts in enumerate(made):
        payload = F.when(F.col("o_orderkey") % 5 == n, F.to_json(F.struct(*parts))).otherwise(payload)
    return read("orders").select("o_orderkey", validate.payload_errors(payload).alias("error"))


@query(
    """
    SELECT event_id, CASE WHEN event_id % 4 = 0 THEN TIMESTAMP '2026-01-01' WHEN event_id % 4 = 1 THEN CAST(CAST(ts AS date) AS timestamp) ELSE date_trunc('second', ts) END AS at FROM events
    """
)
def x23_parsed_times(read):
    at = F.col("event_id") % 4
    whole = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    value = F.when(at == 0, F.when(F.col("event_id") % 8 == 0, "soon")).when(at == 1, F.date_format("ts", "yyyy-MM-dd")).when(at == 2, F.translate(whole, " ", "T")).otherwise(whole)
    found = text.parsed_time(value, F.to_timestamp(F.lit("2026-01-01")))
    return read("events").select("event_id", found.cast("timestamp_ntz").alias("at"))


# Sources of text, and works of another catalog


@query(
    """
    SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'html' WHEN 1 THEN 'open_pdf' WHEN 2 THEN 'abstract' END AS source, CASE page_id % 4 WHEN 0 THEN html WHEN 1 THEN url WHEN 2 THEN 'a' || page_id END AS text FROM pages
    """
)
def s23_text_tiers(read):
    n = F.col("page_id") % 4
    tiers = ("html", F.when(n == 0, F.col("html")).when(n == 1, "")), ("arxiv_pdf", F.lit(None).cast("string")), ("open_pdf", F.when(n <= 1, F.col("url")).otherwise("")), ("abstract", F.when(n <= 2, F.concat(F.lit("a"), "page_id")))
    return read("pages").select("page_id", ids.text_source(*tiers).alias("t")).select("page_id", "t.source", "t.text")


@query(
    """
    WITH w AS (SELECT *, 'W' || p_partkey AS work FROM part)
    SELECT work AS paper_id, p_name AS title, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_brand END AS venue, CAST(1950 + p_size AS int) AS year, CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE p_partkey END AS citation_count,
           CASE WHEN p_partkey % 4 = 0 THEN 0 ELSE 2 END AS reference_count, CASE WHEN p_partkey % 7 = 0 THEN '' ELSE '10.1/' || p_partkey END AS doi, CASE WHEN p_partkey % 2 = 0 THEN 'A' || p_size || ':' || p_brand ELSE '' END AS authors
    FROM w
    """
)
def s06_x20_canonical_works(read):
    key, link = F.col("p_partkey"), lambda c: F.concat(F.lit("https://openalex.org/"), c)
    authors = F.array(F.struct(F.struct(link(F.concat(F.lit("A"), "p_size")).alias("id"), F.col("p_brand").alias("display_name")).alias("author")))
    works = read("part").select(
        link(F.concat(F.lit("W"), key)).alias("id"), F.when(key % 7 != 0, F.concat(F.lit("https://doi.org/10.1/"), key)).alias("doi"), F.col("p_name").alias("display_name"), F.lit(None).cast("string").alias("abstract"),
        (1950 + F.col("p_size")).cast("int").alias("publication_year"), F.when(key % 5 != 0, key).alias("cited_by_count"), F.when(key % 4 != 0, F.array(F.lit("a"), F.lit("b"))).alias("referenced_works"),
        F.when(key % 2 == 0, authors).alias("authorships"), F.when(key % 3 != 0, F.col("p_brand")).alias("venue"),
    )
    listed = F.array_join(F.transform("authors", lambda a: F.concat_ws(":", a["authorId"], a["name"])), ",")
    return serving.canonical_papers(works).select("paper_id", "title", "venue", "year", "citation_count", "reference_count", F.col("external_ids.DOI").alias("doi"), listed.alias("authors"))


# Answers, judges and reports


def _answers(read):
    """An answer for each part: null, without predecessor, with an empty one, whole, or with a field missing."""
    n = F.col("p_partkey") % 6
    of = lambda names, gap: F.struct(*[F.when(gap & F.lit(i == 0), None).otherwise(F.concat(F.lit(f"{c} "), "p_partkey")).alias(c) for i, c in enumerate(names)])
    analysis = of(training.ANALYSIS_FIELDS, n == 4).withField("limitations", F.when(n != 5, F.array(F.lit("l"))))
    comparison = of(training.COMPARISON_FIELDS, n == 5).withField("remaining_limitations", F.array(F.lit("r"), F.col("p_brand")))
    chosen = F.when(n == 2, "").when(n != 1, F.concat(F.lit("p"), "p_partkey"))
    return read("part").select("p_partkey", F.when(n != 0, F.struct(chosen.alias("selected_predecessor_id"), analysis.alias("target_analysis"), comparison.alias("comparison"))).alias("answer"))


@query("SELECT p_partkey, p_partkey % 6 IN (1, 3) AS is_valid FROM part")
def p38_valid_answers(read):
    return _answers(read).select("p_partkey", training.is_answer_valid(F.col("answer")).alias("is_valid"))


@query(
    f"""
    SELECT p_partkey, CASE WHEN n IN (0, 1) THEN NULL WHEN n = 2 THEN '' ELSE 'p' || p_partkey END AS chosen, CASE WHEN n IN (0, 4) THEN '' ELSE '{training.ANALYSIS_FIELDS[0]} ' || p_partkey END AS first_analysis,
           CASE WHEN n IN (0, 5) THEN '' ELSE '{training.COMPARISON_FIELDS[0]} ' || p_partkey END AS first_comparison, CASE WHEN n IN (0, 5) THEN '' ELSE 'l' END AS limitations, CASE WHEN n = 0 THEN '' ELSE 'r,' || p_brand END AS remaining
    FROM (SELECT *, p_partkey % 6 AS n FROM part)
    """
)
def p30_p31_flat_answers(read):
    flat = training.flattened(_answers(read))
    return flat.select(
        "p_partkey", F.col("selected_predecessor_id").alias("chosen"), F.col(training.ANALYSIS_FIELDS[0]).alias("first_analysis"), F.col(training.COMPARISON_FIELDS[0]).alias("first_comparison"),
        F.array_join("limitations", ",").alias("limitations"), F.array_join("remaining_limitations", ",").alias("remaining"),
    )


@query(
    """
    SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'prediction is not a dict' WHEN 2 THEN 'missing top-level key: ''comparison'';comparison.remaining_limitations must be a non-empty list'
           WHEN 3 THEN 'invalid breakthrough_level: ''' || lower(p_brand) || ''';target_analysis.limitations must be a non-empty list' ELSE 'secondary_influences[1] missing ''paper_id''' END AS errors FROM part
    """
)
def v05_schema_errors(read):
    n = F.col("p_partkey") % 5
    level = F.when(n == 3, F.col("p_brand")).otherwise("Major")
    analysis = F.struct(level.alias("breakthrough_level"), F.when(n != 3, F.array(F.lit("x"))).alias("limitations"))
    comparison = F.when(n != 2, F.struct(F.array(F.lit("y")).alias("remaining_limitations")))
    influences = F.array(F.struct(F.lit("p").alias("paper_id")), F.struct(F.when(n != 4, "q").alias("paper_id")))
    answer = F.to_json(F.struct(analysis.alias("target_analysis"), comparison.alias("comparison"), F.lit("s").alias("selected_predecessor_id"), influences.alias("secondary_influences")))
    errors = evaluate.schema_errors(F.when(n == 1, F.concat(F.lit("no answer for "), "p_brand")).otherwise(answer))
    return read("part").select("p_partkey", F.array_join(errors, ";").alias("errors"))


def _responses(read):
    """A judge's texts for each customer and field: fenced, cut off, without a score, with a word for a number, or no JSON at all."""
    n = (F.col("c_custkey") + F.col("k")) % 7
    number = F.concat(((F.col("c_custkey") * 3 + F.col("k")) % 6).cast("string"), F.lit(".5"))
    whole = F.concat(F.lit('Per [1]:\n```json\n{"factual_grounding": 4, "logical_coherence": 3 "specificity": 1, "overall": '), number, F.lit(', "reasoning": "fine"}\n```'))
    cut = F.concat(F.lit('{"overall": '), number, F.lit(', "specificity": 2, "why": ["x"'))
    made = F.when(n == 0, F.lit("I can't say")).when(n == 1, cut).when(n == 2, F.lit('{"specificity": 5}')).when(n == 3, F.lit('{"overall": "high", "specificity": 5}')).otherwise(whole)
    fields = F.array(*map(F.lit, evaluate.JUDGED_FIELDS))
    rows = read("customer").select(F.col("c_custkey"), F.posexplode(fields).alias("k", "field"))
    return rows.select(F.col("c_custkey").alias("sample_id"), "field", "k", F.when(n != 6, made).alias("response"))


_SCORES = """
    SELECT c_custkey AS sample_id, k, n, CASE WHEN n IN (1, 4, 5) THEN (c_custkey * 3 + k) % 6 + 0.5 ELSE -1 END AS score
    FROM (SELECT c_custkey, k, (c_custkey + k) % 7 AS n FROM customer, (SELECT unnest(range(5)) AS k))
"""


@query(
    f"""
    SELECT sample_id, CAST(k AS int) AS k, CAST(score AS double) AS score, CAST(CASE n WHEN 1 THEN 2 WHEN 2 THEN 5 WHEN 4 THEN 1 WHEN 5 THEN 1 ELSE -1 END AS double) AS specificity,
           CAST(CASE WHEN n IN (4, 5) THEN 4 ELSE -1 END AS double) AS factual_grounding, CASE WHEN n IN (4, 5) THEN 'fine' WHEN n = 2 THEN '{{"specificity": 5}}' WHEN n IN (0, 3, 6) THEN 'Judge call failed' END AS reasoning
    FROM ({_SCORES})
    """
)
def v11_judge_scores(read):
    found = evaluate.judge_scores(_responses(read))
    reason = F.when(F.startswith("reasoning", F.lit("Judge call failed")), "Judge call failed").when(~F.contains("reasoning", F.lit('"why"')), F.col("reasoning"))
    return found.select("sample_id", "k", "score", "specificity", "factual_grounding", reason.alias("reasoning"))


@query(
    f"""
    SELECT sample_id, CAST(round(sum(score) / 5, 4) AS double) AS judge, CAST(max(score) FILTER (k = 0) AS double) AS selection_reasoning, sample_id % 2 = 0 AS strict, CASE WHEN sample_id % 2 = 0 THEN 1.0::double ELSE 0.5::double END AS mrr
    FROM ({_SCORES}) GROUP BY sample_id
    """
)
def v12_v13_evaluation_rows(read):
    key = F.col("c_custkey")
    samples = read("customer").select(key.alias("sample_id"))
    other = F.when(key % 2 == 0, F.lit("a")).otherwise(F.lit("b"))
    runs = read("customer").select(
        key.alias("sample_id"), other.alias("pred_id"), F.lit("a").alias("truth_id"), F.array(F.lit("a")).alias("pred_others"), F.array(F.lit("c")).alias("truth_others"),
        F.lit("Major").alias("pred_level"), F.lit("major").alias("truth_level"), F.lit(True).alias("has_prediction"),
    )
    scores = evaluate.classification(runs).select("sample_id", "strict", "mrr")
    rows = training.evaluation_rows(samples, scores, evaluate.judged_samples(_responses(read)))
    return rows.select("sample_id", "judge", "selection_reasoning", "strict", "mrr")


@query(
    """
    WITH r AS (SELECT s_suppkey AS model, s_suppkey % 3 AS n, s_suppkey / CAST(20000 AS double) AS x FROM supplier)
    SELECT model, round(strict, 6) AS strict, round(soft, 6) AS soft, round(schema_valid, 6) AS schema_valid, judge, n = 1 AS is_converted, round(0.75 * soft + 0.25 * judge / 5, 6) AS composite
    FROM (SELECT model, n, CAST(CASE WHEN n = 2 THEN 0 ELSE x END AS double) AS strict, CAST(CASE n WHEN 0 THEN x + 0.1 WHEN 1 THEN x ELSE 0 END AS double) AS soft,
                 CAST(CASE n WHEN 0 THEN 0.9 WHEN 1 THEN 1 - (model % 4) / 8.0 ELSE 0 END AS double) AS schema_valid, CAST(CASE n WHEN 0 THEN 3.5 WHEN 1 THEN 3.25 ELSE 0 END AS double) AS judge FROM r)
    """
)
def p32_older_reports(read):
    """Reports of the new form, of the older one, and without numbers, as JSON texts; then models by composite."""
    key = F.col("s_suppkey")
    x = key / F.lit(20000.0)
    new = F.struct(
        F.struct(x.alias("predecessor_strict"), (x + 0.1).alias("predecessor_soft"), F.lit(0.9).alias("schema_valid"), F.lit(8).alias("n")).alias("overall_classification"), F.struct(F.lit(3.5).alias("judge_overall")).alias("overall_judge"),
    )
    old = F.struct(F.struct(x.alias("predecessor_accuracy"), (key % 4).alias("n_schema_errors"), F.lit(8).alias("n_samples"), F.lit(3.25).alias("judge_overall_mean")).alias("aggregate"))
    rows = read("supplier").select(key.alias("model"), F.when(key % 3 == 0, F.to_json(new)).when(key % 3 == 1, F.to_json(old)).otherwise("{}").alias("report"))
    found = evaluate.select_model(evaluate.normalized_reports(rows))
    r = lambda c: F.round(c, 6).alias(c)
    return found.select("model", r("strict"), r("soft"), r("schema_valid"), "judge", "is_converted", r("composite"))


def answer(prompt: str) -> str:
    """A model that fails on every fifth length of a prompt."""
    if len(prompt) % 5 == 0:
        raise RuntimeError(f"length {len(prompt)}")
    return prompt[:10]


@query(
    """
    SELECT conv_id || '/' || turn AS sample_id, CASE WHEN n % 5 > 0 THEN substr(t, 1, 10) END AS raw_prediction, CASE WHEN n % 5 = 0 THEN 'RuntimeError: length ' || n END AS error, CAST(CASE WHEN n % 5 = 0 THEN 3 ELSE 1 END AS int) AS attempts
    FROM (SELECT conv_id, turn, coalesce(text, '') AS t, length(coalesce(text, '')) AS n FROM conversations)
    """
)
def v16_inference(read):
    samples = read("conversations").select(F.concat_ws("/", "conv_id", "turn").alias("sample_id"), F.col("text").alias("input_text"))
    return training.infer(samples, answer, attempts=3)


@query("SELECT count(*) AS total, 'v' || (count(*) // 50) AS version, count(*) - (count(*) // 50) * 50 >= 50 AS is_due FROM orders")
def k23_pipeline_state(read):
    """The state after a run on all examples, written and read again; whether the next run is due."""
    spark = read("orders").sparkSession
    total = read("orders").count()
    trained = total // 50 * 50
    path = new_path(spark, "state.json")
    put_text(spark, path, f'{{"total": {total}, "trained": {trained}, "version": "v{trained // 50}"}}')
    return spark.read.schema("total long, trained long, version string").json(path).select("total", "version", (F.col("total") - F.col("trained") >= 50).alias("is_due"))
