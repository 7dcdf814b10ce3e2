"""Near-duplicates by MinHash bands, with sequential Bayesian verification and exact completion.

A set's signature holds the smallest values of HASHES hash functions over its shingles. Two sets of similarity s agree in each with a
chance of s, and share a band (ROWS of them) with 1 - (1 - s^ROWS)^BANDS: at 0.85 all but one pair in ten million meet.

Pairs that meet are compared in batches of their signatures. After n values with m agreements, a uniform prior makes the
similarity Beta(m + 1, n - m + 1); a pair whose posterior chance of being near is below MISS is pruned, the others go on to the next
batch, and the shingles of both decide about those that are left.

A bucket of equal copies is one set. In other buckets each set is compared with one pivot, in PIVOT_ROUNDS rounds with another one
each, so a group of close copies becomes a component in linear work. What is left are buckets in which several components meet. In small
ones (CROWD sets at most) all pairs of different components are compared, so rows stay linear. Sets of larger ones, whatever their number, go
through shingle_links' prefix filter, which finds every near pair among them without forming all pairs. Thus no bucket is cut.

Defined results: words are lower-cased (A-Z) and split at ASCII white space; texts of fewer words than a shingle are one shingle; null
counts as empty; texts without words have an empty set and are linked with nothing; a null doc_id is never chosen as component_id
unless the component has no other, and is kept only then; an empty table gives an empty table; further columns change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citemill.llm.common import attach, bounded, discard, read_table, written
from citemill.llm.shingle_links import Rule, Verifier, keyed, lowest_rows, near_components, open_buckets, ordered_pairs, pivot_rounds, profiles, set_id, shingles
from citemill.llm.simhash_dedup import repeated_rows
from citemill.operators.graph import link_components

RULE = Rule(3, 17, 20)
BANDS, ROWS = 28, 5
HASHES = BANDS * ROWS
SEED = 20_13
#: Values of a batch, and the posterior chance of being near below which a pair is pruned.
BATCH, MISS = 28, 1e-9
PIVOT_ROUNDS = 2
#: Sets of a bucket whose pairs are compared one by one.
CROWD = 32

_random = np.random.default_rng(SEED)
_XOR = _random.integers(0, 1 << 64, HASHES, dtype=np.uint64)
_TIMES = _random.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = _random.integers(0, 1 << 63, (ROWS, BANDS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(tokens: np.ndarray) -> np.ndarray:
    """The upper halves of the least hash values of a set, as unsigned 32-bit numbers; no tokens: the greatest numbers."""
    least = np.full(HASHES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(tokens), 512):
        values = (tokens[at : at + 512].view("<u8")[:, None] ^ _XOR) * _TIMES
        np.minimum(least, values.min(axis=0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """For each row of signatures BANDS numbers that are equal where the rows' bands are."""
    values = signatures.astype(np.uint64).reshape(len(signatures), BANDS, ROWS)
    keys = np.broadcast_to(_MIX[0] >> np.uint64(1), (len(signatures), BANDS)).copy()
    for i in range(ROWS):
        keys = (keys ^ values[:, :, i]) * _MIX[i]
        keys ^= keys >> np.uint64(29)
    return keys.view(np.int64)


def fewest_agreements(near: float, batch: int = BATCH, hashes: int = HASHES, miss: float = MISS) -> list[tuple[int, int]]:
    """(n, m) for each batch: after n values, pairs with fewer than m agreements are pruned. With m agreements the posterior
    chance of a similarity of near or more is that of at most m successes in n + 1 trials of chance near."""
    found = []
    for n in range(batch, hashes + 1, batch):
        chance, m = 0.0, 0
        while m <= n:
            chance += comb(n + 1, m) * near**m * (1 - near) ** (n + 1 - m)
            if chance >= miss:
                break
            m += 1
        found.append((n, m))
    return found


def signatures(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, row_key, set_id, n (its shingles), signature and bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sets = [shingles(t.as_py(), RULE.words) for t in part.column(2)]
                found = np.array([signature(s) for s in sets])
                bands = pa.ListArray.from_arrays(pa.array(np.arange(0, BANDS * len(sets) + 1, BANDS), type=pa.int32()), pa.array(band_keys(found).reshape(-1)))
                columns = [pa.array([set_id(s) for s in sets], type=pa.int64()), pa.array([len(s) for s in sets], type=pa.int64()), pa.array([x.tobytes() for x in found], type=pa.binary()), bands]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns], names=["doc_id", "row_key", "set_id", "n", "signature", "bands"])

    rows = keyed(docs)
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, row_key long, set_id long, n long, signature binary, bands array<long>")


def prune(pairs: DataFrame, rows: DataFrame, lowest: DataFrame, repeats: bool) -> DataFrame:
    """The pairs (a, b) of sets that no batch of their signatures rules out. Only signatures that pairs ask for are read."""
    pairs = written(pairs, "minhash-pairs")
    ids = pairs.select(F.col("a").alias("set_id")).union(pairs.select("b")).distinct()
    needed = written(lowest.join(ids, "set_id", "left_semi").select("low.row_key"), "minhash-needed")
    asked = rows.join(bounded(needed), "row_key", "left_semi").select("set_id", "n", "signature")
    asked = written(asked.dropDuplicates(["set_id"]) if repeats else asked, "minhash-asked")
    for side in ("a", "b"):
        pairs = pairs.join(asked.select(F.col("set_id").alias(side), F.struct("n", "signature").alias(f"of_{side}")), side)
    limits = fewest_agreements(RULE.near / RULE.of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint32).reshape(batch.num_rows, HASHES) for c in (2, 3))
            alive, agreed, done = np.arange(batch.num_rows), np.zeros(batch.num_rows, dtype=np.int64), 0
            for n, least in limits:
                agreed += (one[alive, done:n] == two[alive, done:n]).sum(axis=1)
                stays = agreed >= least
                alive, agreed, done = alive[stays], agreed[stays], n
            yield batch.select([0, 1]).take(pa.array(alive))

    compared = pairs.filter(RULE.lengths("of_a", "of_b")).select("a", "b", F.col("of_a.signature").alias("x"), F.col("of_b.signature").alias("y"))
    left = written(compared.mapInArrow(run, "a long, b long"), "minhash-left")
    discard(asked, needed)
    return left


def crowd_components(docs: DataFrame, lowest: DataFrame, crowd: DataFrame, links: DataFrame, repeats: bool) -> DataFrame:
    """(node, root) with all near pairs among the sets of crowd (set_id) linked besides."""
    needed = written(lowest.join(crowd, "set_id", "left_semi").select("low.row_key"), "crowd-needed")
    some = keyed(docs).join(bounded(needed), "row_key", "left_semi").select("doc_id", "text")
    rows = written(profiles(some, RULE), "crowd-rows")
    return near_components(some, rows, lowest_rows(rows), RULE, links, repeats, repeats)


def components(docs: DataFrame, rows: DataFrame, lowest: DataFrame, shared_sets: bool, repeats: bool) -> DataFrame:
    """(node, root) for the sets (not empty) that are linked to others; rows: signatures() of docs."""
    token = rows.filter("n > 0").select("set_id", F.explode("bands").alias("token"))
    token = token.distinct() if shared_sets else token
    shared = written(token.groupBy("token").agg(F.count("*").alias("members")).filter("members > 1").select("token"), "minhash-shared")
    members = written(token.join(shared, "token", "left_semi").select("token", F.struct("set_id").alias("x")), "minhash-members")
    total = members.count()
    verify = Verifier(docs, lowest, RULE, repeats)

    def near(met: DataFrame) -> DataFrame:
        return verify.near(prune(ordered_pairs(met), rows, lowest, repeats))

    links = pivot_rounds(members, total, docs.sparkSession.createDataFrame([], "a long, b long"), near, PIVOT_ROUNDS)
    there = open_buckets(members, links, total)
    if there is None:
        verify.close()
        return link_components(links)
    few = there.filter(F.col("size") <= CROWD).select("token", "x", "root")
    links = links.unionByName(near(few.join(few.select("token", F.col("x").alias("y"), F.col("root").alias("other")), "token").filter("x.set_id < y.set_id and root <> other")))
    verify.close()
    crowd = written(there.filter(F.col("size") > CROWD).select("x.set_id").distinct(), "crowd")
    discard(there)
    return link_components(links) if crowd.isEmpty() else crowd_components(docs, lowest, crowd, links, repeats)


def link_documents(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    rows = written(signatures(docs), "minhash-rows")
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key")
    lowest = written(rows.filter("n > 0").groupBy("set_id").agg(F.min(first).alias("low"), F.count("*").alias("rows")), "minhash-lowest")
    repeats = not repeated_rows(rows).isEmpty()
    roots = components(docs, rows, lowest, lowest.count() < rows.filter("n > 0").count(), repeats)
    rooted = written(lowest.join(roots.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("root", F.coalesce("root", "set_id")), "rooted")
    whole = rooted.groupBy("root").agg(F.min("low").alias("first"), F.count("*").alias("sets"))
    several = written(whole.filter("sets > 1").select("root", "first"), "linked")
    table = rooted.join(several, "root", "left").select("set_id", "rows", F.coalesce("first.doc_id", "low.doc_id").alias("component_id"))
    found = attach(rows.select("doc_id", "set_id", "n"), written(table, "components"), "set_id", "rows", rows.count())
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def op13_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_documents(read_table(spark, sf_dir, "documents"))
