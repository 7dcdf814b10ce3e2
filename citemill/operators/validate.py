"""Record validation: the first rule that fails names the error."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_ERROR_RATE = 0.10


class ValidationFailed(ValueError):
    """Too many records are invalid, or an input has the wrong shape."""


def blank(x: Column) -> Column:
    return x.isNull() | (x == "")


def _first(*rules: tuple[Column, Column]) -> Column:
    """The message of the first condition that holds, else null."""
    found = F.lit(None).cast("string")
    for condition, message in reversed(rules):
        found = F.when(condition, message).otherwise(found)
    return found


def paper_error(papers: DataFrame) -> Column:
    """Checks paper_id, title, year (whole number, 1900 to 2030) and citation_count (given, not negative). A year of 0
    counts as missing; string columns hold what was read before types are known."""
    kinds = dict(papers.dtypes)

    def number(name: str) -> Column:
        return F.expr(f"try_cast({name} as bigint)") if kinds[name] == "string" else F.col(name)

    year, count, year_number, count_number = F.col("year"), F.col("citation_count"), number("year"), number("citation_count")
    return _first(
        (blank(F.col("paper_id")), F.lit("Missing paperId")),
        (blank(F.col("title")), F.lit("Missing title")),
        (year.isNotNull() & year_number.isNull(), F.lit("Invalid year type")),
        (count_number.isNull(), F.lit("Invalid citationCount type")),
        ((year_number != 0) & ~year_number.between(1900, 2030), F.concat(F.lit("Invalid year: "), year.cast("string"))),
        (count_number < 0, F.concat(F.lit("Negative citationCount: "), count.cast("string"))),
    )


def edge_error(edges: DataFrame, lists: bool) -> Column:
    """Checks both ends, that they differ, the flag, and with lists (references) that contexts and intents are arrays."""
    kinds = dict(edges.dtypes)
    rules = [
        (blank(F.col("from_id")), F.lit("Missing fromPaperId")),
        (blank(F.col("to_id")), F.lit("Missing toPaperId")),
        (F.col("from_id") == F.col("to_id"), F.lit("Self-citation detected")),
        (F.col("is_influential").isNotNull() & F.lit(kinds["is_influential"] != "boolean"), F.lit("Invalid isInfluential type")),
    ]
    for name in ("contexts", "intents") if lists else ():
        if name in kinds:
            rules.append((F.col(name).isNotNull() & F.lit(not kinds[name].startswith("array")), F.lit(f"Invalid {name} type")))
    return _first(*rules)


@dataclass
class Checked:
    """Rows with error null, and the others."""

    valid: DataFrame
    errors: DataFrame


def split_valid(rows: DataFrame, error: Column) -> Checked:
    marked = rows.withColumn("error", error)
    return Checked(marked.filter("error is null").drop("error"), marked.filter("error is not null"))


def validation_report(papers: DataFrame, refs: DataFrame, cits: DataFrame) -> DataFrame:
    """One row: numbers of records and errors of each kind, and error_rate."""
    counts = []
    for name, rows, error in (("papers", papers, paper_error(papers)), ("references", refs, edge_error(refs, True)), ("citations", cits, edge_error(cits, False))):
        counts.append(rows.select(F.lit(name).alias("kind"), error.isNotNull().cast("bigint").alias("bad")))
    total = counts[0].unionByName(counts[1]).unionByName(counts[2])
    number = lambda kind, bad: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("bad") if bad else 1)), F.lit(0)).cast("bigint")
    columns = [number(k, b).alias(f"{k}_errors" if b else f"total_{k}") for b in (False, True) for k in ("papers", "references", "citations")]
    rate = F.coalesce(F.avg(F.col("bad").cast("double")), F.lit(0.0))
    return total.agg(*columns, rate.alias("error_rate"))


def check_error_rate(report: DataFrame, limit: float = MAX_ERROR_RATE) -> float:
    """The gate after validation: raises above the limit."""
    rate = report.first()["error_rate"]
    if rate > limit:
        raise ValidationFailed(f"error rate {rate:.1%} is above {limit:.0%}")
    return rate


def check_request(paper_id: str, max_depth: int | None, direction: str) -> int:
    """The depth to use; a missing or zero depth is 3."""
    depth = max_depth or 3
    if not paper_id or not paper_id.strip():
        raise ValidationFailed("paper_id is empty")
    if not isinstance(depth, int) or not 1 <= depth <= 5:
        raise ValidationFailed("max_depth is from 1 to 5")
    if direction not in ("backward", "forward", "both"):
        raise ValidationFailed("direction is backward, forward or both")
    return depth


#: What a payload holds.
PAYLOAD_KEYS = {"target_paper_id", "papers", "references", "citations"}


def check_payload(payload: dict) -> None:
    missing = PAYLOAD_KEYS - payload.keys()
    if missing:
        raise ValidationFailed(f"missing {sorted(missing)}")
    if payload["papers"].isEmpty():
        raise ValidationFailed("no papers")


def request_errors(paper_id: Column, max_depth: Column, direction: Column) -> Column:
    """check_request() for a table of requests: the first rule that fails, else null."""
    depth = used_depth(max_depth)
    return (
        F.when(F.trim(F.coalesce(paper_id, F.lit(""))) == "", "paper_id is empty").when(~depth.between(1, 5), "max_depth is from 1 to 5")
        .when(~F.coalesce(direction.isin("backward", "forward", "both"), F.lit(False)), "direction is backward, forward or both")
    )


def used_depth(max_depth: Column) -> Column:
    """A missing or zero depth is 3."""
    return F.coalesce(F.nullif(max_depth, F.lit(0)), F.lit(3))


def payload_errors(payload: Column) -> Column:
    """check_payload() for a table of payloads in JSON: the missing keys, or that there are no papers, else null."""
    keys = F.coalesce(F.json_object_keys(payload), F.array().cast("array<string>"))
    missing = F.array_except(F.array(*map(F.lit, sorted(PAYLOAD_KEYS))), keys)
    papers = F.coalesce(F.json_array_length(F.get_json_object(payload, "$.papers")), F.lit(0))
    return F.when(F.size(missing) > 0, F.concat(F.lit("missing "), F.array_join(missing, ", "))).when(papers == 0, "no papers")
