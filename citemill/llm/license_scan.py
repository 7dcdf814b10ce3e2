"""License scans by patience alignment.

A text and a template are compared word by word. Words that are unique in both are anchors; the longest increasing
subsequence of the anchors' places aligns them, and each gap between two anchors is aligned in the same way, until no
word is unique in both sides of a gap. Coverage is the aligned share of the template's words.

A template is aligned only where its own words stand: at the runs of words, none further from the next than the
template is long, that hold its less common words. A run whose distinct words can't reach the wanted coverage is left
out, which changes no result. So a text may hold a license several times, and every word of the text is looked at.

Defined results: a null or empty text has no findings; equal rows have equal findings; an empty table gives an empty
table; columns other than id and text are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citemill.llm.common import read_table, text_or_empty
from citemill.llm.license_texts import COMMON, TEMPLATES

COVERAGE = 0.8
#: Where so much of a template is aligned in no more words than it has, its other places there aren't tried.
NEARLY_WHOLE = 0.95
WORD = re.compile(r"[^\W_]+(?:[.'+][^\W_]+)*")


def words_of(text: str) -> tuple[list[str], list[int], list[int]]:
    """Lower-case words with their start and end in the text."""
    words, starts, ends = [], [], []
    for m in WORD.finditer(text):
        words.append(m.group().lower())
        starts.append(m.start())
        ends.append(m.end())
    return words, starts, ends


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of pairs (ascending in the first) that ascends in the second, by patience sorting."""
    tops: list[int] = []
    piles: list[int] = []
    before: list[int] = []
    for n, (_, b) in enumerate(pairs):
        at = bisect_left(tops, b)
        before.append(piles[at - 1] if at else -1)
        if at == len(tops):
            tops.append(b)
            piles.append(n)
        else:
            tops[at], piles[at] = b, n
    found, n = [], piles[-1] if piles else -1
    while n >= 0:
        found.append(pairs[n])
        n = before[n]
    return found[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places (in a, in b) of words aligned in order."""
    found: list[tuple[int, int]] = []
    gaps = [(0, len(a), 0, len(b))]
    while gaps:
        a0, a1, b0, b1 = gaps.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            found.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            found.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {b[n]: n for n in range(b0, b1) if in_b[b[n]] == 1}
        anchors = increasing([(n, place[a[n]]) for n in range(a0, a1) if in_a[a[n]] == 1 and a[n] in place])
        if anchors:
            found += anchors
            for (x0, y0), (x1, y1) in zip([(a0 - 1, b0 - 1), *anchors], [*anchors, (a1, b1)]):
                gaps.append((x0 + 1, x1, y0 + 1, y1))
    return sorted(found)


def apart(windows: Iterable[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of windows (start, end, matched) those without overlap that match most words in all, then the shortest, by start."""
    ordered = sorted(windows, key=lambda w: (w[1], w[0], w[2]))
    ends = [w[1] for w in ordered]
    best: list[tuple[int, int]] = [(0, 0)]  # of the first n windows: words matched, less their lengths
    taken: list[int] = []  # for each window how many come before it if it is taken; -1 if it isn't
    for n, (start, end, matched) in enumerate(ordered):
        earlier = bisect_right(ends, start, 0, n)
        with_it = (best[earlier][0] + matched, best[earlier][1] - (end - start))
        taken.append(earlier if with_it > best[n] else -1)
        best.append(max(with_it, best[n]))
    found, n = [], len(ordered)
    while n:
        if taken[n - 1] < 0:
            n -= 1
        else:
            found.append(ordered[n - 1])
            n = taken[n - 1]
    return found[::-1]


@dataclass(frozen=True)
class Finding:
    license: str
    start: int
    end: int
    coverage: float


class Scanner:
    def __init__(self, templates: dict[str, str] = TEMPLATES, coverage: float = COVERAGE):
        self.coverage = coverage
        self.templates = {name: words_of(text)[0] for name, text in templates.items()}
        self.marks = {name: frozenset(words) - COMMON for name, words in self.templates.items()}
        self.counts = {name: Counter(words) for name, words in self.templates.items()}
        self.any_mark = frozenset().union(*self.marks.values())

    def scan(self, text: str) -> list[Finding]:
        """All findings, by start; of those that overlap the ones stay that match most words in all."""
        words, starts, ends = words_of(text)
        places: dict[str, list[int]] = {}
        for n, word in enumerate(words):
            if word in self.any_mark:
                places.setdefault(word, []).append(n)
        if not places:
            return []
        found: list[tuple[int, int, int, str, float]] = []
        for name, template in self.templates.items():
            marked = sorted(n for word in self.marks[name] for n in places.get(word, ()))
            for first, last in self._runs(marked, len(template)):
                low, high = max(0, first - len(template)), min(len(words), last + len(template) + 1)
                there = Counter(words[low:high])
                if sum(min(k, there[w]) for w, k in self.counts[name].items()) < self.coverage * len(template):
                    continue
                found += self._aligned(name, words, low, high)
        best = {f[:3]: f for f in sorted(found, key=lambda f: (f[4], f[3]))}  # of equal windows the better covered
        return [Finding(f[3], starts[f[0]], ends[f[1] - 1], f[4]) for f in map(best.get, apart(best))]

    @staticmethod
    def _runs(marked: list[int], reach: int) -> Iterator[tuple[int, int]]:
        at = 0
        for n in range(1, len(marked) + 1):
            if n == len(marked) or marked[n] - marked[n - 1] > reach:
                yield marked[at], marked[n - 1]
                at = n

    def _aligned(self, name: str, words: list[str], low: int, high: int) -> Iterator[tuple[int, int, int, str, float]]:
        """The template in words[low:high], again and again in what is left beside a finding. Where the license stands there
        more than once, so that no word is unique, it is tried at each place that a mark word gives it."""
        template = self.templates[name]
        spans = [(low, high)]
        while spans:
            low, high = spans.pop()
            if high - low < self.coverage * len(template):
                continue
            there = Counter(words[low:high])
            if min(there[w] // k for w, k in self.counts[name].items()) > 1:
                yield from self._slid(name, words, low, high)
                continue
            pairs = self._dense(align(words[low:high], template), len(template))
            share = len(pairs) / len(template)
            if share >= self.coverage:
                start, end = low + pairs[0][0], low + pairs[-1][0] + 1
                yield start, end, len(pairs), name, round(share, 6)
                spans += [(low, start), (end, high)]
            else:
                yield from self._slid(name, words, low, high)

    def _slid(self, name: str, words: list[str], low: int, high: int) -> Iterator[tuple[int, int, int, str, float]]:
        """The template wherever a mark word of words[low:high] puts its start, places that most words agree on first. A
        window has the template's length or, for words put in, a quarter or the whole of it more on each side."""
        template = self.templates[name]
        size = len(template)
        offsets: dict[str, list[int]] = {}
        for n, word in enumerate(template):
            if word in self.marks[name]:
                offsets.setdefault(word, []).append(n)
        votes = Counter(n - k for n in range(low, high) for k in offsets.get(words[n], ()))
        found: set[tuple[int, int, int]] = set()
        whole = bytearray(high - low)
        for at in sorted(votes, key=lambda d: (-votes[d], d)):
            if whole[min(max(at + size // 2, low), high - 1) - low]:
                continue
            for slack in (0, size // 4, size):
                first, last = max(low, at - slack), min(high, at + size + slack)
                there = Counter(words[first:last])
                if sum(min(k, there[w]) for w, k in self.counts[name].items()) < self.coverage * size:
                    continue
                pairs = self._dense(align(words[first:last], template), size)
                if len(pairs) < self.coverage * size:
                    continue
                start, end = first + pairs[0][0], first + pairs[-1][0] + 1
                found.add((start, end, len(pairs)))
                if len(pairs) >= NEARLY_WHOLE * size and end - start <= size:
                    whole[start - low : end - low] = b"\1" * (end - start)
                if len(pairs) == size:
                    break
        chosen, at = apart(found), low
        for start, end, matched in chosen:
            yield start, end, matched, name, round(matched / size, 6)
        # What is left beside the chosen windows may hold the license still: a window of two copies hid it.
        for start, end, _ in [*chosen, (high, high, 0)] if chosen else ():
            yield from self._aligned(name, words, at, start)
            at = end

    @staticmethod
    def _dense(pairs: list[tuple[int, int]], size: int) -> list[tuple[int, int]]:
        """The longest part of an alignment without a jump of more than half the template in the text."""
        best: list[tuple[int, int]] = []
        part: list[tuple[int, int]] = []
        for pair in pairs:
            if part and pair[0] - part[-1][0] > max(2, size // 2):
                part = []
            part.append(pair)
            if len(part) > len(best):
                best = list(part)
        return best


def find_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES, coverage: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, license, start, end (code points, end exclusive) and coverage of every finding."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, coverage)
        for batch in batches:
            rows = [(n, f) for n, text in enumerate(batch.column(1)) for f in scanner.scan(text.as_py())]
            ids = batch.column(0).take(pa.array([n for n, _ in rows], type=pa.int64()))
            columns = [pa.array([f.license for _, f in rows], type=pa.string()), *(pa.array([getattr(f, k) for _, f in rows], type=pa.int64()) for k in ("start", "end")), pa.array([f.coverage for _, f in rows], type=pa.float64())]
            yield pa.RecordBatch.from_arrays([ids, *columns], names=["doc_id", "license", "start", "end", "coverage"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, license string, start long, end long, coverage double")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_licenses(read_table(spark, sf_dir, "documents"))
