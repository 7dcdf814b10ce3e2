"""All registered queries of the citation engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from citemill.plans import evaluation_queries, file_queries, stream_queries  # noqa: F401, register their queries
from citemill.plans.queries import ORACLES, QUERIES, flagship_top_influence  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["flagship_top_influence"](spark, sf_dir)
