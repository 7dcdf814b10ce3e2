"""Training examples: seeds, validity, metadata, conversion, inference and per-sample evaluation rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citemill.functions.ids import primary_field
from citemill.functions.metrics import temporal_gap
from citemill.sources.storage import numbered

#: Fields that answers must fill.
ANALYSIS_FIELDS = ["problem_addressed", "core_method", "key_innovation", "breakthrough_level", "explanation_eli5", "explanation_intuitive", "explanation_technical"]
COMPARISON_FIELDS = ["what_was_improved", "how_it_was_improved", "why_it_matters", "problem_solved_from_predecessor"]
INPUT_LIMIT = 350_000


def in_fields(rows: DataFrame, fields: list[str], column: str = "field") -> DataFrame:
    return rows.filter(F.col(column).isin(fields))


def eligible_seeds(found: DataFrame, known: DataFrame) -> DataFrame:
    """Papers with an id and an arXiv id that aren't seeds yet, once each."""
    usable = found.filter("coalesce(paper_id, '') <> '' and coalesce(arxiv_id, '') <> ''").dropDuplicates(["paper_id"])
    return usable.join(known.select("paper_id"), "paper_id", "left_anti")


def remaining_seeds(seeds: DataFrame, runs: DataFrame, n: int) -> DataFrame:
    """The first n seeds, by position, without a successful run."""
    done = runs.filter("status = 'success'").select(F.col("seed_paper_id").alias("paper_id"))
    return seeds.join(done, "paper_id", "left_anti").orderBy("pos").limit(n)


def validity(lines: DataFrame) -> DataFrame:
    """lines (value) -> total, valid and invalid non-blank lines; valid ones are JSON with text in input and output."""
    given = lambda k: F.coalesce(F.get_json_object("value", f"$.{k}"), F.lit("")) != ""
    good = F.coalesce(F.try_parse_json("value").isNotNull() & given("input") & given("output"), F.lit(False))
    rows = lines.filter(F.trim("value") != "").select(good.alias("good"))
    return rows.agg(F.count("*").alias("total"), F.count_if("good").alias("valid"), F.count_if(~F.col("good")).alias("invalid"))


def check_validity(report: DataFrame) -> None:
    if not report.first()["valid"]:
        raise ValueError("no valid training examples")


def paper_metadata(papers: DataFrame) -> DataFrame:
    field = primary_field(F.col("fields"), F.col("sourced_fields"))
    return papers.select("paper_id", "title", "year", "citation_count", field.alias("field_of_study"), F.col("external_ids.ArXiv").alias("arxiv_id"))


def sidecar(examples: DataFrame) -> DataFrame:
    """examples (pos, input, output, metadata, level_info) -> sample_index and original_index from 0 by position (one
    example each), the pair of texts and the metadata columns; examples without either text are left out."""
    whole = F.expr("coalesce(input, '') <> '' and coalesce(output, '') <> ''").alias("_whole")
    keys = numbered(examples.select("pos", whole), "pos", "original_index")
    keys = numbered(keys, "pos", "sample_index", of="_whole").filter("_whole").drop("_whole")
    kept = examples.join(keys, "pos")
    meta, target, before = F.col("metadata"), F.col("level_info.target_paper"), F.col("level_info.predecessor_paper")
    return kept.select(
        "sample_index", "original_index", F.col("input").alias("input_text"), F.col("output").alias("output_text"),
        F.coalesce(meta["target_paper_id"], target["paper_id"]).alias("seed_paper_id"), target["year"].alias("seed_paper_year"), target["citation_count"].alias("seed_citation_count"),
        target["field_of_study"].alias("seed_field_of_study"), F.coalesce(meta["predecessor_paper_id"], before["paper_id"]).alias("predecessor_paper_id"), before["year"].alias("predecessor_paper_year"),
        F.coalesce(meta["depth"], F.lit(0)).alias("depth"), F.coalesce(meta["candidates_considered"], F.lit(0)).alias("candidate_list_size"), meta["target_source_type"].alias("source_type"),
        meta["model"].alias("model_used"), F.coalesce("level_info.lineage_chain", F.array().cast("array<string>")).alias("lineage_chain"), before.isNull().alias("is_terminal"),
        temporal_gap(target["year"], before["year"]).alias("temporal_gap"),
    )


def enough_rows(rows: DataFrame) -> DataFrame:
    """Rows with text; raises without any."""
    kept = rows.filter(F.trim(F.coalesce("text", F.lit(""))) != "")
    if kept.isEmpty():
        raise ValueError("no training rows with text")
    return kept


def is_answer_valid(answer: Column) -> Column:
    """answer: struct selected_predecessor_id, target_analysis, comparison. A null predecessor is valid as it is; an empty
    one isn't; otherwise all fields are filled."""
    chosen = answer["selected_predecessor_id"]
    given = lambda part, names: [F.coalesce(answer[part][n], F.lit("")) != "" for n in names]
    whole = F.lit(True)
    for c in [*given("target_analysis", ANALYSIS_FIELDS), *given("comparison", COMPARISON_FIELDS)]:
        whole = whole & c
    return F.when(answer.isNull(), False).when(chosen.isNull(), True).when(chosen == "", False).otherwise(whole)


def flattened(answers: DataFrame, column: str = "answer") -> DataFrame:
    """The nested answer as flat columns with empty defaults; the chosen id may stay null."""
    a = F.col(column)
    text = lambda c: F.coalesce(c, F.lit(""))
    listed = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    return answers.select(
        *[c for c in answers.columns if c != column], a["selected_predecessor_id"].alias("selected_predecessor_id"),
        *[text(a["target_analysis"][n]).alias(n) for n in ANALYSIS_FIELDS], listed(a["target_analysis"]["limitations"]).alias("limitations"),
        *[text(a["comparison"][n]).alias(n) for n in COMPARISON_FIELDS], listed(a["comparison"]["remaining_limitations"]).alias("remaining_limitations"),
    )


def infer(pending: DataFrame, call: Callable[[str], str], attempts: int = 7, wait: Callable[[int], None] = lambda n: None) -> DataFrame:
    """pending (sample_id, input_text) through a model: sample_id, raw_prediction, error, attempts. Each text is cut to
    INPUT_LIMIT characters and tried up to attempts times; wait(n) is called before a further try."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for sample, text in zip(batch["sample_id"], batch["input_text"]):
                answer, error = None, None
                for n in range(1, attempts + 1):
                    try:
                        answer, error = call((text or "")[:INPUT_LIMIT]), None
                        break
                    except Exception as e:  # a model may fail in any way; the last failure is the row's error
                        error = f"{type(e).__name__}: {e}"
                        if n < attempts:
                            wait(n)
                rows.append((sample, answer, error, n))
            yield pd.DataFrame(rows, columns=["sample_id", "raw_prediction", "error", "attempts"])

    return pending.select("sample_id", "input_text").mapInPandas(run, "sample_id string, raw_prediction string, error string, attempts int")


def evaluation_rows(samples: DataFrame, scores: DataFrame, judged: DataFrame) -> DataFrame:
    """samples with their classification scores and judge axes; samples that weren't judged keep null axes."""
    return samples.join(scores, "sample_id").join(judged, "sample_id", "left")


def new_examples(total: int, trained: int, least: int = 50) -> bool:
    return total - trained >= least


def promote(registry: DataFrame, version: str, stage: str, now: Column) -> DataFrame:
    """The registry with this version in the stage; what was in that stage before is archived."""
    moved = F.when(F.col("version") == version, stage).when(F.col("stage") == stage, "archived").otherwise(F.col("stage"))
    changed = (F.col("version") == version) | (F.col("stage") == stage)
    return registry.withColumns({"stage": moved, "updated_at": F.when(changed, now).otherwise(F.col("updated_at"))})


def rollback_candidates(registry: DataFrame, current: str) -> DataFrame:
    return registry.filter(F.col("version") != current).orderBy(F.desc("registered_at"), "version")
