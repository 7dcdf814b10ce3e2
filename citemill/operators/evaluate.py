"""Scores of model outputs against reference answers, their aggregates, slices and gates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citemill.functions.metrics import composite, cosine, mean_of, reciprocal_rank, set_f1
from citemill.functions.parsing import parse_output
from citemill.sources.storage import written

#: Keys and levels of a valid answer.
TOP_KEYS = ["target_analysis", "comparison", "selected_predecessor_id", "secondary_influences"]
LEVELS = ["minor", "moderate", "major", "revolutionary"]
MIN_SLICE = 3
LIMITS = {"accuracy": 0.15, "judge": 0.8, "semantic": 0.10}


def classification(rows: DataFrame) -> DataFrame:
    """rows (pred_id, truth_id, pred_others, truth_others, pred_level, truth_level, has_prediction) with strict, soft,
    mrr, f1 and level_correct; all zero without a prediction."""
    some = F.col("has_prediction")
    strict = F.col("pred_id").eqNullSafe(F.col("truth_id"))
    soft = strict | F.coalesce(F.array_contains("truth_others", F.col("pred_id")), F.lit(False))
    level = F.coalesce(F.lower("pred_level"), F.lit("")) == F.coalesce(F.lower("truth_level"), F.lit(""))
    return rows.withColumns(
        {
            "strict": F.when(some, strict).otherwise(False),
            "soft": F.when(some, soft).otherwise(False),
            "mrr": F.when(some, reciprocal_rank(F.col("truth_id"), F.col("pred_id"), F.col("pred_others"))).otherwise(0.0),
            "f1": F.when(some, set_f1(F.col("pred_others"), F.col("truth_others"))).otherwise(0.0),
            "level_correct": F.when(some, level).otherwise(False),
        }
    )


def schema_errors(answer: Column) -> Column:
    """Messages for an answer (JSON text): missing keys, an unknown level, empty lists, influences without id. One
    message says that it is no object."""
    v = F.try_parse_json(answer)
    has = lambda path: F.try_variant_get(v, path, "variant").isNotNull()
    items = lambda path: F.try_variant_get(v, path, "array<variant>")
    level = F.lower(F.try_variant_get(v, "$.target_analysis.breakthrough_level", "string"))
    checks = [F.when(~has(f"$.{k}") & ~F.contains(answer, F.lit(f'"{k}"')), F.lit(f"missing top-level key: '{k}'")) for k in TOP_KEYS]
    checks += [
        F.when((level != "") & ~level.isin(LEVELS), F.concat(F.lit("invalid breakthrough_level: '"), level, F.lit("'"))),
        F.when(F.coalesce(F.size(items("$.target_analysis.limitations")), F.lit(0)) <= 0, F.lit("target_analysis.limitations must be a non-empty list")),
        F.when(F.coalesce(F.size(items("$.comparison.remaining_limitations")), F.lit(0)) <= 0, F.lit("comparison.remaining_limitations must be a non-empty list")),
    ]
    listed = F.transform(F.coalesce(items("$.secondary_influences"), F.array().cast("array<variant>")), lambda x, i: F.when(F.try_variant_get(x, "$.paper_id", "string").isNull(), F.concat(F.lit("secondary_influences["), i.cast("string"), F.lit("] missing 'paper_id'"))))
    return F.when(v.isNull(), F.array(F.lit("prediction is not a dict"))).otherwise(F.array_compact(F.concat(F.array(*checks), listed)))


def judge_overall(axes: list[Column]) -> Column:
    """The mean of the five axes, rounded; a missing one counts -1, as a failed one does."""
    return F.round(mean_of(*[F.coalesce(a, F.lit(-1.0)) for a in axes]), 4)


def aggregate(rows: DataFrame, *by: str) -> DataFrame:
    """n_samples, rates of strict, soft and level_correct, means of mrr and f1, and of judge (negatives left out)."""
    rate = lambda c: F.round(F.coalesce(F.avg(F.col(c).cast("double")), F.lit(0.0)), 4)
    judged = F.when(F.col("judge") >= 0, F.col("judge"))
    return rows.groupBy(*by).agg(
        F.count("*").alias("n_samples"), *[rate(c).alias(f"{c}_rate") for c in ("strict", "soft", "level_correct")], rate("mrr").alias("mrr"), rate("f1").alias("f1"),
        F.round(F.coalesce(F.avg(judged), F.lit(0.0)), 4).alias("judge"), F.count_if(~F.col("has_prediction")).alias("n_failed"),
    )


def sliced(rows: DataFrame, *dimensions: str) -> DataFrame:
    """n, accuracy, judge and semantic of every slice; each row is in one slice of every dimension. One pass."""
    each = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("slice")) for d in dimensions])).alias("s")
    exploded = rows.select(each, F.col("strict").cast("double").alias("strict"), "judge", "semantic").select("s.*", "strict", "judge", "semantic")
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    return exploded.groupBy("dimension", "slice").agg(F.count("*").alias("n"), mean("strict").alias("accuracy"), mean("judge").alias("judge"), mean("semantic").alias("semantic"))


def disparities(slices: DataFrame, least: int = MIN_SLICE) -> DataFrame:
    """dimension, metric, disparity and violated: the largest difference between slices of enough rows, 0 for fewer than two."""
    metrics = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in LIMITS])).alias("m")
    large = slices.select("dimension", F.col("n") >= least, metrics).toDF("dimension", "large", "m")
    value = F.when(F.col("large"), F.col("m.value"))
    limit = F.create_map(*[F.lit(x) for pair in LIMITS.items() for x in pair])
    gap = F.when(F.count(value) >= 2, F.max(value) - F.min(value)).otherwise(0.0)
    found = large.groupBy("dimension", F.col("m.metric").alias("metric")).agg(gap.alias("disparity"))
    return found.withColumn("violated", F.col("disparity") > limit[F.col("metric")])


def text_similarity(rows: DataFrame, a: str, b: str) -> DataFrame:
    return rows.withColumn("similarity", cosine(F.col(a), F.col(b)))


def list_similarity(truth: DataFrame, predicted: DataFrame, key: str = "sample", block: int = 2048) -> DataFrame:
    """key and similarity: for each vector of truth the best cosine among the predicted ones of its key, averaged. Both
    have columns key and vector; keys with only one side have similarity 0, keys without truth aren't in the result.

    The vectors of a key are compared as matrices, block by block, and rows stay in number those of the vectors. A key's truth is
    dealt out in lots of about block vectors, so that a large key is many tasks, each with the key's predictions passing by."""
    numbered = written(truth.select(key, "vector", F.monotonically_increasing_id().alias("_at")), "truth-vectors")
    lots = numbered.groupBy(key).agg(F.ceil(F.count("*") / block).alias("_lots"))
    of_truth = numbered.join(lots, key).select(key, F.pmod(F.xxhash64("_at"), F.col("_lots")).alias("_lot"), F.lit(0).alias("_kind"), "_at", "vector")
    of_predicted = predicted.select(key, "vector").join(lots, key).select(key, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_lots") - 1)).alias("_lot"), F.lit(1).alias("_kind"), F.lit(None).cast("long").alias("_at"), "vector")
    together = of_truth.unionByName(of_predicted).withColumnRenamed(key, "_key")
    dealt = together.repartition("_key", "_lot").sortWithinPartitions("_key", "_lot", "_kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, vectors, best = None, [], None

        def done() -> pa.RecordBatch:
            found = np.zeros(len(vectors)) if best is None else best
            return pa.RecordBatch.from_arrays([pa.array([now[0]] * len(found), type=batch.schema.field("_key").type), pa.array(found)], names=["_key", "best"])

        for batch in batches:
            keys, lots_, kinds = (batch.column(i).to_pylist() for i in range(3))
            starts = [0, *(i for i in range(1, len(keys)) if (keys[i], lots_[i], kinds[i]) != (keys[i - 1], lots_[i - 1], kinds[i - 1])), len(keys)]
            for start, end in zip(starts, starts[1:]):
                if start == end:
                    continue
                if now != (keys[start], lots_[start]):
                    if vectors:
                        yield done()
                    now, vectors, best, ones = (keys[start], lots_[start]), [], None, None
                part = batch.column("vector").slice(start, end - start).to_pylist()
                if kinds[start] == 0:
                    vectors += part
                    continue
                ones = _unit(vectors) if ones is None else ones
                for at in range(0, len(part), block):
                    top = (ones @ _unit(part[at : at + block], ones.shape[1]).T).max(axis=1)
                    best = top if best is None else np.maximum(best, top)
        if vectors:
            yield done()

    kind = truth.schema[key].dataType.simpleString()
    return dealt.mapInArrow(run, f"_key {kind}, best double").groupBy(F.col("_key").alias(key)).agg(F.avg("best").alias("similarity"))


def _unit(vectors: list[list[float] | None], dim: int | None = None) -> np.ndarray:
    """Rows of length one; null, empty and zero vectors, and those of another length, are zeros."""
    dim = max((len(v or ()) for v in vectors), default=0) if dim is None else dim
    rows = np.array([v if v is not None and len(v) == dim else [0.0] * dim for v in vectors], dtype=np.float64).reshape(len(vectors), dim)
    norms = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0)


#: The fields that a judge scores, and the axes of each score.
JUDGED_FIELDS = ["selection_reasoning", "what_was_improved", "how_it_was_improved", "why_it_matters", "problem_solved_from_predecessor"]
JUDGE_AXES = ["factual_grounding", "logical_coherence", "domain_consistency", "specificity"]
#: The numbers of a report, with their names in older reports. Numbers that neither has are 0.
REPORT_FIELDS = {
    "strict": ("predecessor_strict", "predecessor_accuracy"),
    "soft": ("predecessor_soft", "predecessor_accuracy"),
    "mrr": ("mrr", "predecessor_mrr"),
    "level": ("breakthrough", "breakthrough_level_accuracy"),
    "f1": ("secondary_f1", "secondary_influences_f1_mean"),
}


def judge_scores(responses: DataFrame, column: str = "response") -> DataFrame:
    """responses with score, reasoning and an axis each of JUDGE_AXES, from a judge's text: -1 where a number is missing, and also
    in all of them where the text holds no object or a number isn't one; then the reasoning says why."""
    parsed = responses.withColumn("_p", parse_output(F.col(column)))
    value = F.try_parse_json("_p.parsed")
    numbers = {"score": "overall", **{a: a for a in JUDGE_AXES}}
    given = {n: F.try_variant_get(value, f"$.{key}", "variant") for n, key in numbers.items()}
    as_number = {n: F.try_variant_get(value, f"$.{key}", "double") for n, key in numbers.items()}
    is_object = F.startswith("_p.parsed", F.lit("{"))
    broken = F.lit(False)
    for n in numbers:
        broken = broken | (given[n].isNotNull() & as_number[n].isNull())
    failed = ~F.coalesce(is_object, F.lit(False)) | F.coalesce(broken, F.lit(False))
    reason = F.when(failed, F.concat(F.lit("Judge call failed: "), F.coalesce("_p.error", F.lit("not an object of numbers")))).otherwise(F.coalesce(F.try_variant_get(value, "$.reasoning", "string"), F.col(column)))
    scores = {n: F.when(failed, -1.0).otherwise(F.coalesce(as_number[n], F.lit(-1.0))) for n in numbers}
    return parsed.withColumns(scores | {"reasoning": reason}).drop("_p")


def judged_samples(responses: DataFrame) -> DataFrame:
    """responses (sample_id, field, response) -> a row for each sample: the score of each of JUDGED_FIELDS (-1 if it has none or
    failed) and judge, the mean of all five, rounded. Of several responses for a field the highest score counts."""
    rows = judge_scores(responses).groupBy("sample_id").pivot("field", JUDGED_FIELDS).agg(F.max("score"))
    return rows.select("sample_id", *[F.coalesce(f, F.lit(-1.0)).alias(f) for f in JUDGED_FIELDS], judge_overall([F.col(f) for f in JUDGED_FIELDS]).alias("judge"))


def normalized_reports(reports: DataFrame, column: str = "report") -> DataFrame:
    """reports with the numbers of a report in JSON beside it, in place of the text: REPORT_FIELDS, schema_valid, judge, n_samples, and
    whether it was of an older form. That has all numbers in aggregate, no soft rate of its own (strict counts), and the
    number of schema errors instead of the share of valid answers. A report of neither form has zeros."""
    number = ", ".join
    new = number(f"{n} double" for n, _ in REPORT_FIELDS.values()) + ", schema_valid double, n long"
    old = number(sorted({f"{n} double" for _, n in REPORT_FIELDS.values()})) + ", n_schema_errors long, n_samples long, judge_overall_mean double"
    r = F.from_json(column, f"overall_classification struct<{_typed(new)}>, overall_judge struct<judge_overall:double>, aggregate struct<{_typed(old)}>")
    rows = reports.withColumn("_r", r)
    is_new, aggregate_ = F.col("_r.overall_classification").isNotNull(), F.col("_r.aggregate")
    is_old = ~is_new & aggregate_.isNotNull()
    either = lambda a, b: F.coalesce(F.when(is_new, a).when(is_old, b), F.lit(0.0))
    fields = {c: either(F.col(f"_r.overall_classification.{n}"), aggregate_[o]) for c, (n, o) in REPORT_FIELDS.items()}
    some = F.greatest(F.coalesce(aggregate_["n_samples"], F.lit(1)), F.lit(1))
    valid = either(F.col("_r.overall_classification.schema_valid"), 1.0 - F.coalesce(aggregate_["n_schema_errors"], F.lit(0)) / some)
    judge = either(F.col("_r.overall_judge.judge_overall"), aggregate_["judge_overall_mean"])
    n = F.coalesce(F.when(is_new, F.col("_r.overall_classification.n")).when(is_old, aggregate_["n_samples"]), F.lit(0)).cast("long")
    return rows.withColumns(fields | {"schema_valid": valid, "judge": judge, "n_samples": n, "is_converted": is_old}).drop("_r", column)


def _typed(fields: str) -> str:
    return ",".join(f.replace(" ", ":") for f in fields.split(", "))


def select_model(reports: DataFrame) -> DataFrame:
    """reports (model, soft, judge) with composite and rank, 1 the winner; ties by name."""
    scored = reports.withColumn("composite", composite(F.col("soft"), F.col("judge")))
    return scored.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("composite"), "model")))


def promotion(winner: DataFrame, production: DataFrame) -> DataFrame:
    """The winner with promote: there is no production model, or the winner is strictly better."""
    now = production.agg(F.max("composite").alias("current"))
    return winner.join(F.broadcast(now)).withColumn("promote", F.col("current").isNull() | (F.col("composite") > F.col("current")))


def matching_version(versions: DataFrame, winner: str) -> DataFrame:
    return versions.filter(F.contains(F.lower("version"), F.lit(winner.lower()))).orderBy("version").limit(1)


def pending(samples: DataFrame, done: DataFrame) -> DataFrame:
    """Samples without a run that has neither error nor parse_error."""
    good = done.filter("error is null and parse_error is null").select("sample_id")
    return samples.join(good, "sample_id", "left_anti")


def joined_results(samples: DataFrame, inference: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Samples with their results, and the samples without any."""
    return samples.join(inference, "sample_id"), samples.join(inference, "sample_id", "left_anti")
