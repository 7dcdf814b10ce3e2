"""Packing tokenised documents into sequences by best-fit decreasing.

Documents are cut into pieces of at most CAPACITY tokens; full pieces are sequences of their own. The other pieces are
dealt by a hash into lots of about LOT_ROWS, sorted by decreasing length, and packed: a segment tree over the
remaining capacities 1 to CAPACITY finds the tightest open sequence that still has room in log2(CAPACITY) steps.
All lots see the same mix of lengths, so each is about as full as one lot of everything; a lot leaves less than one
sequence half empty.

Token ids of a white-space separated word don't depend on its neighbours (the tokenizer drops white space, and no rule
of it looks across), so the different words of a batch of texts are encoded once, and for as long as they stay in a bounded
memory not again.

Defined results: a null text counts as empty: one piece with the end token alone; equal rows are packed each on its own;
an empty table gives an empty table; columns other than id and text are not read.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from citemill.llm.common import kept, read_table, text_or_empty, written

CAPACITY = 4096
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
LOT_ROWS = 20_000
#: Words whose ids a worker remembers, about 200 bytes each, and the longest of them.
MEMORY_WORDS, LONGEST = 300_000, 100
#: Bytes of text that are encoded together; a longer text is encoded alone.
TOGETHER = 1 << 20
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Plain words: ASCII, and letters whose lower case and whose bytes don't depend on what stands beside them. Letters that
#: don't stay letters when they are normalised and lower-cased may end in a combining mark, which goes with punctuation.
PLAIN = "^[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*$"
#: A plain word up to the punctuation at its end. There the tokenizer always parts it.
STEM = "^.*[^!-/:-@\\[-`{-~]"
#: Letters in lower case, and where the tokenizer parts a plain word of them.
LETTERS = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+")
PARTS = re.compile("'(?:s|t|re|ve|m|ll|d)|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^0-9a-z\u00df-\u00f6\u00f8-\u00ff]+")
#: A tokenizer that gives these what its model alone gives the byte-level lower case of their parts may be asked so.
PROBES = ("a", "Hello", "STRASSE", "\u00c9lan", "ni\u00f1o", "stra\u00dfe", "\u00d8re", "unbelievably", "It'S", "don't,ll", "--'s'll", "v2.10", "(a1B2)...")


class Remembered:
    """Ids of words: of any until half of what fits is full, then of those that come often.

    A full half is put aside in place of the other, and its words are taken back as they are met.
    """

    def __init__(self, ids_of: Callable[[str], bytes]):
        self.ids_of, self.known, self.aside = ids_of, {}, {}

    def look_up(self, words: list[str], often: list[bool]) -> list[bytes]:
        """The ids of each word; often says which come more than once."""
        found = list(map(self.known.get, words))
        for n, ids in enumerate(found):
            if ids is None:
                found[n] = self._beyond(words[n], often[n])
        return found

    def _beyond(self, word: str, often: bool) -> bytes:
        ids = self.aside.get(word)
        if ids is None:
            ids = self.ids_of(word)
            if len(word) > LONGEST or self.aside and not often:
                return ids
        if len(self.known) >= MEMORY_WORDS // 2:
            self.known, self.aside = {}, self.known
        self.known[word] = ids
        return ids


def strung(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids and lengths of a sequence of codes, where ids has the ids of code 0, of code 1 and so on, of these lengths."""
    taken = lengths[codes]
    shift = (np.cumsum(lengths) - lengths)[codes] - (np.cumsum(taken) - taken)
    return ids[np.repeat(shift, taken) + np.arange(taken.sum())], taken


class WordEncoder:
    """Token ids of whole texts, as little-endian unsigned 32-bit numbers.

    The different words of many texts are looked up once: plain ones by the lower case of what stands before the punctuation
    at their end. The tokenizer's model alone gives the ids of their parts; other words are given to the tokenizer whole.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        in_bytes = ByteLevel(add_prefix_space=False, use_regex=False)
        self.in_bytes = {n: in_bytes.pre_tokenize_str(chr(n))[0][0] for n in range(0xC0, 0x100)}
        self.figures = {n: self._of_model(n) for n in "0123456789"}
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.direct = all("<|" in t.content for t in added) and all(self._of_parts(w.lower()) == self._whole(w) for w in PROBES)
        self.memory = Remembered(self._of_word)

    def encode(self, text: str) -> bytes:
        return next(self.of_each(pa.array([text], pa.string())))

    def of_each(self, texts: pa.Array) -> Iterator[bytes]:
        for run in together(texts):
            ids, ends = self._of_texts(run)
            start = 0
            for end in ends.tolist():
                yield ids[start:end].tobytes()
                start = end

    def _of_texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and where each text's ids end."""
        words = pc.ascii_split_whitespace(texts)
        coded = words.flatten().dictionary_encode()
        codes = coded.indices.to_numpy()
        ids, lengths = strung(*self._of_words(coded.dictionary, np.bincount(codes, minlength=len(coded.dictionary))), codes)
        starts = words.offsets.to_numpy() - words.offsets[0].as_py()
        return ids, np.concatenate([[0], np.cumsum(lengths)])[starts[1:]]

    def _of_words(self, words: pa.Array, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one after the other, and their lengths."""
        if not self.direct:
            return self._of_stems(words, counts)
        plain = pc.and_not(pc.match_substring_regex(words, PLAIN), pc.match_substring(words, "<|"))  # not a special token
        lower = pc.utf8_lower(words)
        stems = pc.if_else(plain, pc.utf8_rtrim(lower, PUNCTUATION), words).dictionary_encode()
        ends = pc.if_else(plain, pc.replace_substring_regex(lower, STEM, ""), "").dictionary_encode()
        both = np.stack([stems.indices.to_numpy(), ends.indices.to_numpy() + len(stems.dictionary)], axis=1).ravel()
        listed = pa.concat_arrays([stems.dictionary, ends.dictionary])
        ids, lengths = strung(*self._of_stems(listed, np.bincount(both, np.repeat(counts, 2), len(listed))), both)
        return ids, lengths.reshape(-1, 2).sum(axis=1)

    def _of_stems(self, stems: pa.Array, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = self.memory.look_up(stems.to_numpy(zero_copy_only=False).tolist(), (counts > 1).tolist())
        return np.frombuffer(b"".join(found), dtype="<u4"), np.fromiter(map(len, found), np.int64, len(found)) // 4

    def _of_word(self, word: str) -> bytes:
        if self.direct and LETTERS.fullmatch(word):
            return self._of_model(word)
        if self.direct and "<|" not in word and re.fullmatch(PLAIN, word):
            return self._of_parts(word)
        return self._whole(word)

    def _whole(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _of_parts(self, word: str) -> bytes:
        """Ids of a plain word of lower-case letters, from the model alone."""
        return b"".join([self.figures.get(p) or self._of_model(p) for p in PARTS.findall(word)])

    def _of_model(self, part: str) -> bytes:
        ids = [t.id for t in self.model.tokenize(part if part.isascii() else part.translate(self.in_bytes))]
        return struct.pack(f"<{len(ids)}I", *ids)


def together(texts: pa.Array) -> Iterator[pa.Array]:
    """Runs of texts of at most TOGETHER bytes, or of one text."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy())
    start = 0
    while start < len(texts):
        before = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + TOGETHER, side="right")))
        yield texts.slice(start, end - start)
        start = end


def encoder_of(path: str) -> WordEncoder:
    """The worker's encoder; later tasks of the worker find the words that earlier ones met, until one of another kind lets it go."""
    return kept(f"encoder {path}", lambda: WordEncoder(path))


class TightestBin:
    """Open bins by remaining capacity: a segment tree whose leaf c counts the bins with c left.

    Nodes hold the number of bins below them; the tightest fit for a length is the first leaf at or right of it
    whose count isn't 0.
    """

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)
        self.bins: dict[int, list[int]] = {}

    def add(self, left: int, number: int) -> None:
        self.bins.setdefault(left, []).append(number)
        self._change(left, 1)

    def _change(self, left: int, by: int) -> None:
        at = left + self.size
        while at:
            self.count[at] += by
            at >>= 1

    def take(self, length: int) -> tuple[int, int] | None:
        """Removes the bin with the least capacity of at least length: (capacity, number)."""
        at, count = length + self.size, self.count
        if not count[at]:
            while at & 1 or not count[at + 1]:  # up, until there is something to the right
                at >>= 1
                if at <= 1:
                    return None
            at += 1
        while at < self.size:
            at = 2 * at if count[2 * at] else 2 * at + 1
        left = at - self.size
        self._change(left, -1)
        return left, self.bins[left].pop()


def best_fit(lengths: list[int], capacity: int) -> Iterator[tuple[int, int]]:
    """(bin, offset) for each length, in the order given; bins are numbered from 0."""
    tree, opened = TightestBin(capacity), 0
    for length in lengths:
        found = tree.take(length)
        left, number = found or (capacity, opened)
        opened += found is None
        yield number, capacity - left
        if left > length:
            tree.add(left - length, number)


PIECES = "piece int, start long, length long, ids_crc32 long"
#: The number of a piece's row while it is packed.
ROW = "_citemill_row"
#: The column of the lot, and the most partitions into which lots are dealt; with more lots a task packs several, one by one.
LOT, MOST_PARTS = "_citemill_lot", 4096


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every document's pieces."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals the work out
        encoder = encoder_of(path)
        for batch in batches:
            rows: list[int] = []
            cut: list[tuple[int, int, int, int]] = []
            for n, ids in enumerate(encoder.of_each(batch.column(1))):
                ids += end
                for piece, start in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[start : start + 4 * capacity]
                    rows.append(n)
                    cut.append((piece, start // 4, len(part) // 4, zlib.crc32(part)))
            columns = np.array(cut, dtype=np.int64).reshape(-1, 4).T
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
            arrays = [pa.array(c.astype(k.to_pandas_dtype()), type=k) for c, k in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, type=pa.int64())), *arrays], names=["doc_id", "piece", "start", "length", "ids_crc32"])
        pa.default_memory_pool().release_unused()  # the worker stays, for stages that need memory of their own

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, {PIECES}")


def _packed(batches: list[pa.RecordBatch], lot: int, capacity: int) -> Iterator[pa.RecordBatch]:
    """The batches of a lot with sequence_id and offset."""
    first = (lot + 1) << 36
    placed = best_fit([n for b in batches for n in b.column("length").to_pylist()], capacity)
    for batch in batches:
        at = np.array([next(placed) for _ in range(batch.num_rows)], dtype=np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at[:, 0] + first), pa.array(at[:, 1])], names=[*batch.schema.names, "sequence_id", "offset"])


def pack(cut: DataFrame, capacity: int = CAPACITY, lot_rows: int = LOT_ROWS) -> DataFrame:
    """cut with sequence_id and offset. Pieces of the full capacity stay where they are."""
    # Pieces get numbers when they are written, so that repeated rows are dealt out like others.
    cut = written(cut.withColumn(ROW, F.monotonically_increasing_id()), "pieces")
    open_ = cut.filter(F.col("length") < capacity)
    lots = max(1, -(-open_.count() // lot_rows))
    lot = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", ROW), F.lit(lots))
    parts, names = min(lots, MOST_PARTS), cut.columns
    dealt = open_.withColumn(LOT, lot).repartitionById(parts, F.pmod(F.col(LOT), F.lit(parts)).cast("int"))
    dealt = dealt.sortWithinPartitions(LOT, F.desc("length"), "doc_id", "piece", "ids_crc32", ROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, waiting = -1, []  # the batches of one lot: about lot_rows rows of numbers
        for batch in batches:
            lots_there = batch.column(LOT).to_numpy()
            starts = [0, *(np.flatnonzero(lots_there[1:] != lots_there[:-1]) + 1).tolist(), batch.num_rows]
            for start, end in zip(starts, starts[1:]):
                if start == end:
                    continue
                if lots_there[start] != number:
                    yield from _packed(waiting, number, capacity)
                    number, waiting = int(lots_there[start]), []
                waiting.append(batch.slice(start, end - start).select(names))
        yield from _packed(waiting, number, capacity)

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema)
    packed = dealt.mapInArrow(run, f"{kinds}, sequence_id long, offset long")
    # A full piece's sequence is named by a negative number; the ids of the others are at or above 0.
    whole = cut.filter(F.col("length") >= capacity)
    name = -1 - F.monotonically_increasing_id()
    return packed.unionByName(whole.withColumn("sequence_id", name).withColumn("offset", F.lit(0).cast("long"))).drop(ROW)


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    return pack(pieces(docs, path or public_tokenizers.path(TOKENIZER), capacity, end_id), capacity)


def op5_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack_documents(read_table(spark, sf_dir, "documents"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
