"""Helpers shared by the corpus operators: written tables, hot keys, word counts, what workers keep."""

from __future__ import annotations

import gc
from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citemill.sources.storage import discard, new_path, written  # noqa: F401, used beside these helpers

#: White space of the word contracts: space and U+0009 to U+000D.
SPACE = " \\x09-\\x0D"
#: A key is hot when it holds more than one in so many rows; so there are at most as many hot keys.
HOT_PARTS = 1000
#: What this Python worker keeps between tasks, by kind.
_kept: dict[str, Any] = {}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def attach(rows: DataFrame, table: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """rows left-joined with table, which has one row for each key and, in weight, the number of rows of that key.

    Keys with more than 1/HOT_PARTS of the total rows are at most HOT_PARTS in number, so they are broadcast
    and their rows don't move; the rest is an ordinary shuffled join.
    """
    is_hot = F.col(weight) * HOT_PARTS > total
    hot, cold = table.filter(is_hot), table.filter(~is_hot)
    near = rows.join(F.broadcast(hot), key)
    far = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key, "left")
    return near.unionByName(far)


def bounded(table: DataFrame, rows: int = 1 << 20) -> DataFrame:
    """A written table, marked for broadcast if it has at most that many rows; a larger one is joined as Spark plans it."""
    return F.broadcast(table) if table.count() <= rows else table


def word_count(text: Column) -> Column:
    """Number of runs of characters other than white space; no text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def kept(kind: str, make: Callable[[], Any]) -> Any:
    """What this Python worker keeps between tasks of a kind, one kind at a time."""
    if kind not in _kept:
        let_go()
        _kept[kind] = make()
    return _kept[kind]


def let_go() -> None:
    """Drops what this worker keeps. Workers outlive stages, so tasks of other kinds that need memory begin with it."""
    if _kept:
        _kept.clear()
        gc.collect()  # an encoder and its memory know each other
        pa.default_memory_pool().release_unused()
