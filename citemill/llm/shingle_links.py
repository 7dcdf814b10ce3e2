"""Near-duplicates by word shingles: links known beforehand, completed to all pairs of a Jaccard similarity or more.

Each text is a set of shingles. The near_dedup stage starts with the links of SimHash fingerprints within two bits, from the
segment-popcount grid of simhash_dedup, so large groups of close copies become components in linear work. But texts of
similarity 0.8 differ in some 10 of 64 bits on average, and at that distance a grid of bit counts holds most pairs of a
corpus. So the rest comes from a prefix filter without loss. All sets are sorted in one order, rare tokens first. Of two sets
of similarity t or more, the longer one (n tokens) has a token of the shorter one (m tokens) among its first n - ceil(t n) + 1, and
that token is among the first m - ceil(2 t m / (1 + t)) + 1 of the shorter one. Tokens that a sample finds often come last in
the order: that saves candidates and changes no result.

A pair that meets is left out only by bounds that no near pair can break: the lengths; the tokens that are left after the
places where it meets (in the last round, behind the first one, as nothing ahead of it is common); and the parities of both sets. A parity is a bit string in which each token flips one bit, so two strings
differ in at most as many bits as the sets have tokens apart. What remains is decided by the shingles.

Pairs at a token grow with the square of its sets. So a few rounds compare each set only with one pivot of each of
its tokens, and the last one compares pairs that are not yet in one component: no link between components is lost. In a crowd
of texts just short of similar, the tokens in which each differs from all others fill the shorter prefix, so members don't meet at all, or are kept
apart by their parities inside the join. Shingles of a text are read only once a pair asks for them.

Defined results: words are lower-cased (A-Z) and split at ASCII white space; texts of fewer words are one shingle; null
counts as empty, and texts without words are equal; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citemill.llm.common import attach, bounded, discard, let_go, text_or_empty, written
from citemill.llm.simhash_dedup import SEED, keep_rows, majority, near_links, repeated_rows, row_key
from citemill.operators.graph import link_components

#: The sample that orders tokens is one in SAMPLE_EVERY documents, but LEAST_SAMPLE at least; tokens in fewer of them than
#: FREQUENT, or beyond the MOST_FREQUENT, keep the order of their hashes.
SAMPLE_EVERY, LEAST_SAMPLE, FREQUENT, MOST_FREQUENT = 200, 5_000, 3, 200_000
PIVOT_ROUNDS = 1
#: Least words of a parity; it has a bit for each token and more.
PARITY_WORDS = 4


@dataclass(frozen=True)
class Rule:
    """Which texts are near: shingles of so many words, with a Jaccard similarity of near / of or more."""

    words: int = 5
    near: int = 4
    of: int = 5

    def prefix(self, n: int) -> int:
        """Tokens of a set among which a near set that isn't longer has one of its own."""
        return n - -(-self.near * n // self.of) + 1

    def index(self, column: str) -> Column:
        """Tokens of a set, counted by a column, among which a near set that isn't shorter has one of its own."""
        return F.expr(f"{column} - ceil(2 * {self.near}L * {column} / {self.near + self.of}D - 1e-9D) + 1")

    def lengths(self, a: str, b: str) -> Column:
        return F.expr(f"least({a}.n, {b}.n) * {self.of}L >= greatest({a}.n, {b}.n) * {self.near}L")

    def room(self, a: str, b: str) -> Column:
        """Whether sets that share a token at these places can have enough tokens in common."""
        return F.expr(f"{self.near + self.of}L * (least({a}.pos, {b}.pos) + least({a}.n - {a}.pos, {b}.n - {b}.pos)) >= {self.near}L * ({a}.n + {b}.n)")

    def room_behind(self, a: str, b: str) -> Column:
        """The same for the first token that the sets share: no token ahead of it is common. A near pair passes at that one."""
        return F.expr(f"{self.near + self.of}L * least({a}.n - {a}.pos, {b}.n - {b}.pos) >= {self.near}L * ({a}.n + {b}.n)")

    def parities(self, a: str, b: str) -> Column:
        """Whether the tokens by which the sets differ at least, by their parities, are few enough. The longer parity is folded to
        the length of the shorter one: that of near sets is at most twice as long."""
        fold = lambda x, y: f"if(size({x}) > size({y}), zip_with(slice({x}, 1, size({y})), slice({x}, size({y}) + 1, size({y})), (p, q) -> p ^ q), {x})"
        one, two = f"{a}.parity", f"{b}.parity"
        apart = f"aggregate(zip_with({fold(one, two)}, {fold(two, one)}, (p, q) -> bit_count(p ^ q)), 0, (s, v) -> s + v)"
        return F.expr(f"{self.near + self.of}L * {apart} <= {self.of - self.near}L * ({a}.n + {b}.n)")

    def shared(self, a: str, b: str) -> Column:
        """Whether two sets are near."""
        return F.expr(f"{self.near + self.of}L * size(array_intersect({a}, {b})) >= {self.near}L * (size({a}) + size({b}))")


NEAR_DEDUP = Rule()


def shingles(text: str, words: int) -> np.ndarray:
    """The hashes of a text's shingles, ascending, each once."""
    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.empty(0, dtype=np.int64)
    runs = [b" ".join(parts)] if len(parts) <= words else map(b" ".join, zip(*(parts[i:] for i in range(words))))
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in runs), dtype="<u8").view("<i8"))


def set_id(found: np.ndarray) -> int:
    """Equal for equal sets."""
    return int.from_bytes(hashlib.blake2b(found.tobytes(), digest_size=8).digest(), "little", signed=True)


def parity(tokens: np.ndarray) -> np.ndarray:
    """A power of two of 64-bit words, with a bit for each token at least; token h flips bit h mod their number."""
    words = PARITY_WORDS
    while words * 64 < len(tokens):
        words *= 2
    flips = np.bincount((tokens.view("<u8") % np.uint64(words * 64)).astype(np.int64), minlength=words * 64) & 1
    return np.packbits(flips.astype(np.uint8), bitorder="little").view("<i8")


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), row_key(id_col, text_col).alias("row_key"), text_or_empty(text_col).alias("text"))


def _listed(sets: list[np.ndarray]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]), type=pa.int32()), pa.array(np.concatenate(sets), type=pa.int64()))


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """set_id and shingles of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                sets = [shingles(t.as_py(), words) for t in batch.column(0).slice(at, 500)]
                yield pa.RecordBatch.from_arrays([pa.array([set_id(x) for x in sets], type=pa.int64()), _listed(sets)], names=["set_id", "shingles"])

    return docs.select("text").mapInArrow(run, "set_id long, shingles array<long>")


def frequent(docs: DataFrame, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of a sample that are in FREQUENT or more of its documents, ascending, and in how many."""
    rows = keyed(docs)
    every = min(SAMPLE_EVERY, max(1, docs.count() // LEAST_SAMPLE))
    sample = _sets(rows.filter(F.pmod("row_key", F.lit(every)) == 0), rule.words).select(F.explode("shingles").alias("token"))
    often = sample.groupBy("token").count().filter(F.col("count") >= FREQUENT).orderBy(F.desc("count"), "token").limit(MOST_FREQUENT).toArrow()
    tokens, counts = (often[c].to_numpy().astype(np.int64) for c in ("token", "count"))
    order = np.argsort(tokens)
    return tokens[order], counts[order]


def profiles(docs: DataFrame, rule: Rule = NEAR_DEDUP) -> DataFrame:
    """One row per document: doc_id, row_key, set_id, fp (its SimHash), n (its shingles), parity, and prefix, the first tokens of
    the set in the common order."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent(docs, rule))  # MOST_FREQUENT numbers at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        known, counts = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows, prefixes, parities = [], [], []
                for text in part.column(2):
                    tokens = shingles(text.as_py(), rule.words)
                    n = len(tokens)
                    rank = np.zeros(n, dtype=np.int64)
                    if len(known):
                        near = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
                        rank = np.where(known[near] == tokens, counts[near], 0)
                    prefixes.append(tokens[np.lexsort((tokens, rank))][: rule.prefix(n)])
                    parities.append(parity(tokens))
                    rows.append((set_id(tokens), majority(tokens.view("<u8")), n))
                ids, prints, sizes = zip(*rows)
                columns = [pa.array(ids, type=pa.int64()), pa.array(np.array(prints, dtype=np.uint64).view(np.int64)), pa.array(sizes, type=pa.int32()), _listed(parities), _listed(prefixes)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns], names=["doc_id", "row_key", "set_id", "fp", "n", "parity", "prefix"])

    rows = keyed(docs)
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, row_key long, set_id long, fp long, n int, parity array<long>, prefix array<long>")


def lowest_rows(rows: DataFrame) -> DataFrame:
    """One written row for each set of profiles(): set_id, low (the document with the smallest doc_id that has it), fp, n, parity."""
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key")
    return written(rows.groupBy("set_id").agg(F.min(first).alias("low"), F.min("fp").alias("fp"), F.min("n").alias("n"), F.min("parity").alias("parity")), "near-lowest")


def close_prints(lowest: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets: those that share a fingerprint, as stars, and one for each link of fingerprints within two bits."""
    prints = written(lowest.groupBy("fp").agg(F.min("set_id").alias("set_id"), F.count("*").alias("sets")), "near-prints")
    same = lowest.join(prints.filter("sets > 1").select("fp", F.col("set_id").alias("first")), "fp").filter("set_id <> first").select(F.col("first").alias("a"), F.col("set_id").alias("b"))
    links = near_links(prints.select("fp"))
    for side in ("a", "b"):
        links = links.join(prints.select(F.col("fp").alias(side), F.col("set_id").alias(f"set_{side}")), side)
    return links.select(F.least("set_a", "set_b").alias("a"), F.greatest("set_a", "set_b").alias("b")).unionByName(same).distinct()


class Verifier:
    """Decides pairs by the shingles of both sets, and remembers the shingles that it has read. repeats: whether rows may
    repeat, so that a set is read several times."""

    def __init__(self, docs: DataFrame, lowest: DataFrame, rule: Rule, repeats: bool):
        self.docs, self.lowest, self.rule, self.repeats, self.sets = docs, lowest, rule, repeats, []

    def known(self) -> DataFrame | None:
        found = None
        for table in self.sets:
            found = table if found is None else found.unionByName(table)
        return found

    def near(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose sets are near, written."""
        pairs = written(pairs, "near-pairs")
        ids = pairs.select(F.col("a").alias("set_id")).union(pairs.select("b")).distinct()
        known = self.known()
        if known is not None:
            ids = ids.join(known.select("set_id"), "set_id", "left_anti")
        needed = written(self.lowest.join(ids, "set_id", "left_semi").select("low.row_key"), "near-needed")
        read = _sets(keyed(self.docs).join(bounded(needed), "row_key", "left_semi"), self.rule.words)
        self.sets.append(written(read.dropDuplicates(["set_id"]) if self.repeats else read, "near-sets"))
        sets = self.known()
        # A set in many pairs is a skewed key of pairs alone; adaptive execution splits such a side.
        rows = pairs
        for side in ("a", "b"):
            rows = rows.join(sets.select(F.col("set_id").alias(side), F.col("shingles").alias(f"set_{side}")), side)
        links = written(rows.filter(self.rule.shared("set_a", "set_b")).select("a", "b"), "near-links")
        for table in (pairs, needed):
            discard(table)
        return links

    def close(self) -> None:
        for table in self.sets:
            discard(table)


def ordered_pairs(met: DataFrame) -> DataFrame:
    """Different sets (a, b), a < b, of rows with structs x and y."""
    return met.filter("x.set_id <> y.set_id").select(F.least("x.set_id", "y.set_id").alias("a"), F.greatest("x.set_id", "y.set_id").alias("b")).distinct()


def with_profiles(pairs: DataFrame, lowest: DataFrame) -> DataFrame:
    """pairs (a, b) with structs p and q, the lengths and parities of both sets."""
    for side, name in (("a", "p"), ("b", "q")):
        pairs = pairs.join(lowest.select(F.col("set_id").alias(side), F.struct("n", "parity").alias(name)), side)
    return pairs


def open_buckets(members: DataFrame, links: DataFrame, total: int, number: int = 0) -> DataFrame | None:
    """The written rows (token, x, root, size, pivot) of members (token, x), total in all, at the tokens where several components
    of links meet; None if there are none. pivot has an x and its root; another number chooses another pivot."""
    roots = link_components(links)
    named = members.select("*", F.col("x.set_id").alias("node")).join(roots, "node", "left")
    left = written(named.select("token", "x", F.coalesce("root", "node").alias("root")), "near-left")
    pivot = F.min_by(F.struct("x", "root"), F.xxhash64("x.set_id", F.lit(number))).alias("pivot")
    open_ = left.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("size"), pivot)
    open_ = written(open_.filter("low <> high").select("token", "size", "pivot"), "near-open")
    there = None if open_.isEmpty() else written(attach(left, open_, "token", "size", total).filter("size is not null"), "near-there")
    discard(left, open_)
    return there


def pivot_rounds(members: DataFrame, total: int, links: DataFrame, near: Callable[[DataFrame], DataFrame], rounds: int) -> DataFrame:
    """links with those that near finds among each member of a bucket and the bucket's pivot, round by round."""
    for number in range(rounds):
        there = open_buckets(members, links, total, number)
        if there is None:
            break
        links = links.unionByName(near(there.filter("root <> pivot.root").select("x", F.col("pivot.x").alias("y"))))
        discard(there)
    return links


def near_components(docs: DataFrame, rows: DataFrame, lowest: DataFrame, rule: Rule = NEAR_DEDUP, links: DataFrame | None = None, shared_sets: bool = True, repeats: bool = True) -> DataFrame:
    """(node, root) for the sets that are linked to others: root is the smallest set_id of the component.

    rows: profiles() of docs; lowest: their lowest_rows(); links: (a, b), links known beforehand, or else those of close
    fingerprints. shared_sets: whether documents may share a set; repeats: whether rows may repeat id and text."""
    token = rows.select("set_id", "n", F.posexplode("prefix").alias("pos", "token"))
    shared = written(token.groupBy("token").agg(F.count("*").alias("members")).filter("members > 1").select("token"), "near-shared")
    members = token.join(shared, "token", "left_semi").select("token", F.struct("set_id", "n", "pos").alias("x"))
    members = written(members.distinct() if shared_sets else members, "near-members")
    total = members.count()
    verify = Verifier(docs, lowest, rule, repeats)
    if links is None:
        links = verify.near(close_prints(lowest))

    def near(met: DataFrame) -> DataFrame:
        can_be = ordered_pairs(met.filter(rule.lengths("x", "y") & rule.room("x", "y")))
        return verify.near(with_profiles(can_be, lowest).filter(rule.parities("p", "q")).select("a", "b"))

    links = pivot_rounds(members, total, links, near, PIVOT_ROUNDS)
    there = open_buckets(members, links, total)
    if there is not None:
        profile = lowest.select("set_id", "parity")
        x = there.select("token", "x.*", "root").join(profile, "set_id").select("token", F.struct("set_id", "n", "pos", "parity").alias("x"), "root")
        x = written(x, "near-members")
        y = x.filter(F.col("x.pos") < rule.index("x.n")).select("token", F.col("x").alias("y"), F.col("root").alias("other"))
        shorter = F.expr("struct(y.n, y.set_id) < struct(x.n, x.set_id)")
        met = x.join(y, "token").filter(F.expr("root <> other") & shorter & rule.lengths("x", "y") & rule.room_behind("x", "y") & rule.parities("x", "y"))
        links = links.unionByName(verify.near(ordered_pairs(met)))
        discard(there, x)
    verify.close()
    return link_components(links)


def deduplicate(docs: DataFrame) -> DataFrame:
    """One document of each component stays, that with the smallest doc_id; the columns stay as they are.

    Rows with the same doc_id and text as the one that stays count as one. Rows without doc_id yield to others;
    among themselves the smallest hash stays.
    """
    rows = written(profiles(docs), "near-rows")
    lowest = lowest_rows(rows)
    repeated = repeated_rows(rows)
    roots = near_components(docs, rows, lowest, NEAR_DEDUP, None, lowest.count() < rows.count(), not repeated.isEmpty())
    rooted = lowest.join(roots.withColumnRenamed("node", "set_id"), "set_id", "left")
    kept = rooted.groupBy(F.coalesce("root", "set_id").alias("root")).agg(F.min("low").alias("low")).select("low.doc_id", "low.row_key").distinct()
    return keep_rows(docs, rows, kept, repeated)
