"""The corpus pipeline: toxicity, exact dedup, near-dedup, mixing, packing. Part of the llm subpackage.

Every stage takes what the one before kept. Defined results: null texts count as empty, and empty texts are documents like
others (one of them stays after exact dedup); null ids yield to others; rows that repeat id and text count as one from exact
dedup on, until the mix repeats documents; null sources are a source of their own, the last; tables without rows
give tables without rows; columns that documents may have besides stay as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from citemill.llm import best_fit, digest_index, mixing, shingle_links, toxicity
from citemill.llm.common import read_table, written


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Documents that a task hands to Python at a time. Spark's 10,000 would be some 40 MB of texts, several times over.
BATCH_ROWS = 1000


def in_batches(stage: Stage) -> Stage:
    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
        return stage(spark, docs, sf_dir)

    return run_stage


@in_batches
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the cut stay; the classifier learns from this stage's documents that have labels."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, read_table(spark, sf_dir, "labels")))


@in_batches
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest doc_id stays."""
    return digest_index.deduplicate(docs, "largest")


@in_batches
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates, by SimHash links and five-word shingles, the document with the smallest doc_id
    stays."""
    return shingle_links.deduplicate(docs)


@in_batches
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, shard by shard in random order; of a source's last document the words that
    its target still lacks."""
    return mixing.drawn(docs).select(*docs.columns)


@in_batches
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in training sequences."""
    return best_fit.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return written(STAGES[-1][1](spark, docs, sf_dir), f"stage-{STAGES[-1][0]}")


#: A trained network decides, and tokens are counted; tests compare run() with a brute-force version.
ORACLE_SQL = None
