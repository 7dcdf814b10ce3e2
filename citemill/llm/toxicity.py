"""Toxicity scores from a convolutional text classifier with thresholds calibrated by language.

A word's embedding is the sum of rows of three hashed tables: for the word, its first four and its first five
letters, so that inflected forms share evidence. Filters of several widths slide over the words of the whole text;
each filter's largest response anywhere in the text (max pooling) feeds a logistic layer. The network is trained in numpy
on all labelled rows; HELD_BACK of them, chosen by a hash of the id, set, for each language, the threshold with the best F1. Up to
SHARD rows are trained on the driver. More are dealt into shards of about as many, each trained by a task from the same start, which
counts of all rows give; the weights of the shards are averaged. Languages are told from the text by function words.

A score is the network's probability moved along the logistic curve so that its language's threshold lands on CUT. So
a score of CUT or more means the same in each language.

Labels are read only from rows whose crc32(doc_id) mod 3 isn't 1; labels, lang, source and doc_id enter no score.
Defined results: a null or empty text gets the score of a text without words; a table without labels of both kinds
gives every text the score 0; rows that repeat are scored alike; an empty table gives an empty table.
"""

from __future__ import annotations

import copy
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citemill.llm.common import bounded, discard, let_go, read_table, text_or_empty, written

CUT = 0.7
#: Labelled rows that are trained together, some 4 bytes a word.
SHARD = 7500
HELD_BACK = 0.25
ROWS, DIM = 1 << 15, 16
WIDTHS = (1, 2, 3)
FILTERS = 8
EPOCHS = 8
#: Words that are scored together, some 400 bytes each; a longer text is scored alone.
CHUNK = 20_000
#: Words whose projections a task remembers, some 400 bytes each; then it starts anew.
MEMORY_WORDS = 60_000
WORD = re.compile(r"\w+")
#: Frequent function words of the languages told apart.
FUNCTION_WORDS = {
    "en": "the of and to in is that for it with as on by this are was be from".split(),
    "de": "der die und das ist den von zu mit sich nicht ein eine im dem auf für".split(),
    "fr": "le les des et est une dans que pour qui pas sur du au par ce sont".split(),
    "es": "el los las y que del por con una para es se su al lo como más".split(),
}
LANGUAGES = [*FUNCTION_WORDS, "other"]


def is_held_out(id_col: Column) -> Column:
    return F.crc32(id_col.cast("string").cast("binary")) % 3 == 1


def features(word: str) -> tuple[int, int, int]:
    """Rows of the embedding table for a word and its first letters."""
    at = [zlib.crc32(f"{n}{part}".encode("utf-8", "surrogatepass")) % ROWS for n, part in enumerate((word, word[:4], word[:5]))]
    return at[0], ROWS + at[1], 2 * ROWS + at[2]


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def function_word(word: str) -> list[int]:
    """For each language, 1 if the word is one of its function words."""
    return [int(name in _LANGUAGES_OF.get(word, ())) for name in FUNCTION_WORDS]


_LANGUAGES_OF: dict[str, list[str]] = {}
for _name, _words in FUNCTION_WORDS.items():
    for _word in _words:
        _LANGUAGES_OF.setdefault(_word, []).append(_name)


@dataclass
class Network:
    """filters[k]: one (DIM, FILTERS) matrix for each of the offsets of each width, in WIDTHS order."""

    table: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: float = 0.0
    thresholds: list[float] = field(default_factory=lambda: [CUT] * len(LANGUAGES))

    @classmethod
    def new(cls, seed: int = 5) -> Network:
        r = np.random.default_rng(seed)
        total = len(WIDTHS) * FILTERS
        return cls(r.normal(0, 0.1, (3 * ROWS, DIM)).astype("f4"), r.normal(0, 0.3, (sum(WIDTHS), DIM, FILTERS)).astype("f4"), np.zeros(total, "f4"), np.abs(r.normal(0, 0.3, total)).astype("f4"), -2.0)

    def projected(self, ids: np.ndarray) -> np.ndarray:
        """What each word (three table rows) adds to each filter at each offset: (words, sum(WIDTHS) * FILTERS)."""
        vectors = self.table[ids].sum(axis=1)
        return vectors @ self.filters.transpose(1, 0, 2).reshape(DIM, -1)

    def pooled(self, projected: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest response of every filter in every text, and the position it starts at. A text is padded by zeros."""
        best, where, column = [], [], 0
        for width in WIDTHS:
            response = np.zeros((len(projected), FILTERS), "f4")
            for offset in range(width):
                part = projected[offset:, column * FILTERS : (column + 1) * FILTERS].copy() if offset else projected[:, column * FILTERS : (column + 1) * FILTERS]
                for back in range(offset):  # the first words of a text aren't part of the text before it
                    beyond = starts[(starts > 0) & (starts < len(projected))] + back - offset
                    part[beyond[(beyond >= 0) & (beyond < len(part))]] = 0
                response[: len(part)] += part
                column += 1
            full = np.flatnonzero(ends > starts)
            top = np.zeros((len(starts), FILTERS), "f4")
            if len(full):
                top[full] = np.maximum.reduceat(response, starts[full], axis=0)
            best.append(top)
            where.append(response)
        return np.concatenate(best, axis=1), where

    def probability(self, pooled: np.ndarray) -> np.ndarray:
        z = np.maximum(pooled + self.bias, 0) @ self.out + self.out_bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def start_from_counts(self, texts: list[np.ndarray], labels: np.ndarray, ids: np.ndarray) -> None:
        """start_from() the numbers of texts of either label that have a row of the table."""
        counts = np.zeros((2, 3 * ROWS))
        for text, label in zip(texts, labels):
            counts[int(label), np.unique(ids[np.unique(text)])] += 1
        self.start_from(counts, labels.mean())

    def start_from(self, counts: np.ndarray, share: float, smoothing: float = 10.0) -> None:
        """Sets the first dimension of the embeddings to the log-odds of the label among the texts that have the row, so
        that the first windows to win the pooling are telling ones; filters begin by looking at it."""
        if not 0 < share < 1:
            return
        odds = np.log((counts[1] + smoothing * share) / (counts[0] + smoothing * (1 - share)) * (1 - share) / share)
        self.table[:, 0] = odds
        self.filters[:, 0, :] = np.abs(self.filters[:, 0, :]) + 0.1

    def weights(self) -> np.ndarray:
        """All weights but the table's as rows of DIM numbers, padded by zeros."""
        flat = np.concatenate([self.filters.ravel(), self.bias, self.out, [self.out_bias]]).astype("f4")
        return np.pad(flat, (0, -len(flat) % DIM)).reshape(-1, DIM)

    def set_weights(self, rows: np.ndarray) -> None:
        flat = rows.astype("f4").ravel()
        n, m = self.filters.size, len(self.bias)
        self.filters, self.bias, self.out = flat[:n].reshape(self.filters.shape), flat[n : n + m], flat[n + m : n + 2 * m]
        self.out_bias = float(flat[n + 2 * m])

    def train(self, texts: list[np.ndarray], labels: np.ndarray, ids: np.ndarray, epochs: int = EPOCHS, rate: float = 0.05, batch: int = 64, seed: int = 5) -> None:
        """texts: word numbers of each text; ids: the table rows of each word number. Adagrad; only the windows that won
        the pooling carry gradients."""
        r = np.random.default_rng(seed)
        params = {"filters": self.filters, "bias": self.bias, "out": self.out}
        seen = {k: np.full_like(v, 1e-2) for k, v in params.items()} | {"table": np.full(3 * ROWS, 1e-2, "f4"), "out_bias": 1e-2}
        first = np.cumsum([0, *WIDTHS])
        usable = np.flatnonzero([len(t) for t in texts])
        for _ in range(epochs):
            order = r.permutation(usable)
            for at in range(0, len(order), batch):
                chosen = order[at : at + batch]
                lengths = np.array([len(texts[i]) for i in chosen])
                ends = np.cumsum(lengths)
                starts = ends - lengths
                words = np.concatenate([texts[i] for i in chosen])
                pooled, responses = self.pooled(self.projected(ids[words]), starts, ends)
                hidden = np.maximum(pooled + self.bias, 0)
                p = 1 / (1 + np.exp(-np.clip(hidden @ self.out + self.out_bias, -30, 30)))
                error = ((p - labels[chosen]) / len(chosen)).astype("f4")
                back = error[:, None] * self.out * (pooled + self.bias > 0)
                grads = {"out": hidden.T @ error, "bias": back.sum(axis=0), "filters": np.zeros_like(self.filters)}
                rows, changes = [], []
                for k, width in enumerate(WIDTHS):
                    g = back[:, k * FILTERS : (k + 1) * FILTERS]
                    winner = np.array([responses[k][s:e].argmax(axis=0) + s for s, e in zip(starts, ends)])
                    for offset in range(width):
                        inside = winner + offset < ends[:, None]
                        at_rows = ids[words[np.minimum(winner + offset, len(words) - 1)]]
                        weight = g * inside
                        grads["filters"][first[k] + offset] += np.einsum("nf,nfd->df", weight, self.table[at_rows].sum(axis=2))
                        rows.append(at_rows.reshape(-1, 3))
                        changes.append((weight[:, :, None] * self.filters[first[k] + offset].T[None]).reshape(-1, DIM))
                for name, value in params.items():
                    seen[name] += grads[name] ** 2
                    value -= rate * grads[name] / np.sqrt(seen[name])
                bias_grad = float(error.sum())
                seen["out_bias"] += bias_grad**2
                self.out_bias -= rate * bias_grad / np.sqrt(seen["out_bias"])
                distinct, inverse = np.unique(np.concatenate(rows), return_inverse=True)
                summed = np.zeros((len(distinct), DIM), "f4")
                np.add.at(summed, inverse.ravel(), np.repeat(np.concatenate(changes), 3, axis=0))
                seen["table"][distinct] += (summed**2).mean(axis=1)
                self.table[distinct] -= rate * summed / np.sqrt(seen["table"][distinct])[:, None]


class Scorer:
    """Scores texts with a network; remembers what it knows of words."""

    def __init__(self, network: Network):
        self.network = network
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.rows = np.empty((0, sum(WIDTHS) * FILTERS), "f4")
        self.spoken = np.empty((0, len(FUNCTION_WORDS)), "u1")

    def _numbers(self, words: list[str]) -> np.ndarray:
        new = [w for w in dict.fromkeys(words) if w not in self.number]
        if self.number and len(self.number) + len(new) > MEMORY_WORDS:
            self._forget()
            new = list(dict.fromkeys(words))
        if new:
            self.number |= zip(new, range(len(self.number), len(self.number) + len(new)))
            self.rows = np.concatenate([self.rows, self.network.projected(np.array([features(w) for w in new]))])
            self.spoken = np.concatenate([self.spoken, np.array([function_word(w) for w in new], dtype="u1")])
        return np.fromiter(map(self.number.__getitem__, words), dtype=np.int64, count=len(words))

    def judge(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """The network's output for each text and the index of its language, the one whose function words are most
        frequent; in chunks of whole texts."""
        found, spoken, at = [np.empty(0)], [np.empty(0, int)], 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= CHUNK):
                size += len(texts[end])
                end += 1
            part = texts[at:end]
            lengths = np.array([len(t) for t in part])
            ends = np.cumsum(lengths)
            numbers = self._numbers([w for t in part for w in t])
            found.append(self.network.probability(self.network.pooled(self.rows[numbers], ends - lengths, ends)[0]))
            sums = np.concatenate([np.zeros((1, len(FUNCTION_WORDS)), int), np.cumsum(self.spoken[numbers], axis=0, dtype=int)])
            counts = sums[ends] - sums[ends - lengths]
            spoken.append(np.where(counts.any(axis=1), counts.argmax(axis=1), len(LANGUAGES) - 1))
            at = end
        return np.concatenate(found), np.concatenate(spoken)

    def scores(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Scores and languages."""
        p, spoken = self.judge(texts)
        p = np.clip(p, 1e-6, 1 - 1e-6)
        cut = np.array(self.network.thresholds)[spoken]
        z = np.log(p / (1 - p)) - np.log(cut / (1 - cut)) + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-z)), spoken


def best_threshold(p: np.ndarray, y: np.ndarray) -> float | None:
    """The middle, on the logistic scale, of the widest gap between probabilities with the best F1; None without both labels."""
    if not len(y) or y.min() == y.max():
        return None
    order = np.argsort(-p, kind="stable")
    z = np.log(np.clip(p[order], 1e-6, 1 - 1e-6) / (1 - np.clip(p[order], 1e-6, 1 - 1e-6)))
    right = np.cumsum(y[order])
    f1 = 2 * right / (np.arange(1, len(y) + 1) + y.sum())
    below = np.append(z[1:], z[-1] - 1)
    usable = np.where(z > below, f1, -1)
    ties = np.flatnonzero(usable >= usable.max() - 1e-9)
    cut = ties[np.argmax((z - below)[ties])]
    return float(np.clip(1 / (1 + np.exp(-(z[cut] + below[cut]) / 2)), 0.01, 0.99))


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text and toxic of all documents with a label that aren't held out. Of rows that repeat a doc_id the smallest text is taken."""
    return _labelled(docs, _known(labels)).orderBy("hash", "text").select("text", "toxic")


def _known(labels: DataFrame) -> DataFrame:
    return labels.filter(F.col("toxic").isNotNull() & ~is_held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))


def _labelled(docs: DataFrame, known: DataFrame) -> DataFrame:
    """hash, text and toxic, a row for each labelled doc_id, in no order."""
    texts = docs.select("doc_id", text_or_empty().alias("text")).join(known, "doc_id")
    texts = texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"))
    return texts.select(F.xxhash64("doc_id").alias("hash"), "text", F.col("toxic").cast("double").alias("toxic"))


def fit(docs: DataFrame, labels: DataFrame, epochs: int = EPOCHS) -> Network | None:
    """The network, or None where there are no labels of both kinds."""
    known = written(_known(labels), "labels")
    rows = _labelled(docs, bounded(known))
    n = known.count()
    if n <= SHARD:
        network = _trained(rows.orderBy("hash", "text").select("text", "toxic").toArrow(), epochs)
    else:
        rows = written(rows, "labelled")
        network = _trained_in_shards(rows, -(-n // SHARD), epochs)
        discard(rows)
    discard(known)
    pa.default_memory_pool().release_unused()  # the driver stays, for stages that need memory of their own
    return network


def _numbered(texts: pa.ChunkedArray) -> tuple[list[np.ndarray], list[str], np.ndarray]:
    """Word numbers of each text, the words, and their rows of the table."""
    number: dict[str, int] = {}
    found = [np.fromiter((number.setdefault(w, len(number)) for w in words_of(t.as_py())), dtype=np.int32) for t in texts]
    ids = np.fromiter((at for w in number for at in features(w)), dtype=np.int32).reshape(-1, 3)
    return found, list(number), ids


def _set_thresholds(network: Network, p: np.ndarray, y: np.ndarray, of: np.ndarray) -> None:
    common = best_threshold(p, y) or 0.5
    network.thresholds = [best_threshold(p[of == n], y[of == n]) or common for n in range(len(LANGUAGES))]


def _trained(rows: pa.Table, epochs: int) -> Network | None:
    y = np.array(rows["toxic"])  # a copy, else it would keep the texts beside it
    if not len(y) or y.min() == y.max():
        return None
    texts, names, ids = _numbered(rows["text"])
    del rows  # word numbers are all that is used from here on
    pa.default_memory_pool().release_unused()
    network = Network.new()
    held = np.zeros(len(y), dtype=bool)
    held[:: round(1 / HELD_BACK)] = True
    seen, back = ([t for t, h in zip(texts, held) if h == kind] for kind in (False, True))
    network.start_from_counts(seen, y[~held], ids)
    network.train(seen, y[~held], ids, epochs)
    # A few texts at a time are words again, and what is known of words goes with them.
    p, of = (np.concatenate(x) for x in zip(*(Scorer(network).judge([[names[i] for i in t] for t in back[at : at + 64]]) for at in range(0, len(back), 64))))
    _set_thresholds(network, p, y[held], of)
    return network


def _trained_in_shards(rows: DataFrame, shards: int, epochs: int) -> Network | None:
    """As _trained(), of rows (hash, text, toxic) that are written. The driver gets counts and weights, whose number is fixed, and 13
    bytes of each row that is held back."""
    context = rows.sparkSession.sparkContext
    held = F.pmod(F.shiftright("hash", 20), F.lit(round(1 / HELD_BACK))) == 0
    seen, back = rows.filter(~held), rows.filter(held).select("text", "toxic")
    share = seen.agg(F.avg("toxic")).first()[0]
    if not share or share == 1:
        return None

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        counts, known = np.zeros((2, 3 * ROWS), dtype=np.int64), {}
        for batch in batches:
            for text, label in zip(batch.column(0), batch.column(1).to_pylist()):
                words = set(words_of(text.as_py()))
                if len(known) > MEMORY_WORDS:
                    known.clear()
                new = [w for w in words if w not in known]
                known.update(zip(new, map(features, new)))
                counts[int(label), np.unique(np.array([known[w] for w in words], dtype=np.int64))] += 1
        at = np.flatnonzero(counts.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[0, at]), pa.array(counts[1, at])], names=["row", "clean", "toxic"])

    found = seen.select("text", "toxic").mapInArrow(count, "row long, clean long, toxic long").groupBy("row").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toArrow()
    counts = np.zeros((2, 3 * ROWS))
    counts[:, np.array(found["row"])] = np.array(found["clean"]), np.array(found["toxic"])
    network = Network.new()
    network.start_from(counts, share)
    start = context.broadcast(network)

    def learn(shard: pa.Table) -> pa.Table:
        let_go()
        shard = shard.sort_by([("hash", "ascending"), ("text", "ascending")])
        own, y = copy.deepcopy(start.value), np.array(shard["toxic"])
        texts, _, ids = _numbered(shard["text"])
        own.train(texts, y, ids, epochs)
        met = np.unique(ids)
        dense = own.weights()
        values = np.concatenate([own.table[met], dense]).astype("f4")
        at = np.concatenate([met, 3 * ROWS + np.arange(len(dense))])
        return pa.table({"row": pa.array(at, pa.int64()), "v": pa.FixedSizeListArray.from_arrays(values.ravel(), DIM).cast(pa.list_(pa.float32()))})

    dealt = seen.withColumn("shard", F.pmod("hash", F.lit(shards)))
    learnt = dealt.groupBy("shard").applyInArrow(learn, "row long, v array<float>")
    # Rows of the table are averaged over the shards that have them.
    means = learnt.groupBy("row").agg(*(F.avg(F.col("v")[i]).alias(f"v{i}") for i in range(DIM))).toArrow()
    at, values = np.array(means["row"]), np.stack([np.array(means[f"v{i}"]) for i in range(DIM)], axis=1).astype("f4")
    in_table = at < 3 * ROWS
    network.table[at[in_table]] = values[in_table]
    network.set_weights(values[~in_table][np.argsort(at[~in_table])])
    shared = context.broadcast(network)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        scorer = Scorer(shared.value)
        for batch in batches:
            for n in range(0, batch.num_rows, 256):
                part = batch.slice(n, 256)
                p, of = scorer.judge([words_of(t.as_py()) for t in part.column(0)])
                yield pa.RecordBatch.from_arrays([pa.array(p, pa.float64()), part.column(1), pa.array(of, pa.int32())], names=["p", "toxic", "language"])

    judged = back.mapInArrow(judge, "p double, toxic double, language int").orderBy("p", "toxic", "language").toArrow()
    _set_thresholds(network, *(np.array(judged[c]) for c in ("p", "toxic", "language")))
    return network


def score(docs: DataFrame, network: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score and language (told from the text) of every document."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    if network is None:
        return rows.select("doc_id", F.lit(0.0).alias("score"), F.lit("other").alias("language"))
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        scorer = Scorer(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                scores, spoken = scorer.scores([words_of(t.as_py()) for t in part.column(1)])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores, type=pa.float64()), pa.array([LANGUAGES[n] for n in spoken])], names=["doc_id", "score", "language"])

    return rows.mapInArrow(run, f"doc_id {kind}, score double, language string")


def keep_clean(docs: DataFrame, network: Network | None, cut: float = CUT) -> DataFrame:
    """The rows of docs whose score is below cut, with the columns of docs."""
    if network is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(network)

    @F.arrow_udf("double")
    def scores(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        let_go()
        scorer = Scorer(shared.value)
        for batch in texts:
            # A few texts at a time are Python strings.
            parts = [scorer.scores([words_of(t.as_py()) for t in batch.slice(at, 256)])[0] for at in range(0, len(batch), 256)]
            yield pa.array(np.concatenate(parts) if parts else np.empty(0), type=pa.float64())

    return docs.filter(scores(F.col("text")) < cut)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (read_table(spark, sf_dir, t) for t in ("documents", "labels"))
    rows = score(docs, fit(docs, labels))
    return rows.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"), "language")
