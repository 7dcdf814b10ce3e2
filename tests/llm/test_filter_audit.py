"""The filter audit against plain loops over all orders."""

from __future__ import annotations

import random
import re
from itertools import permutations

from citemill.llm import filter_audit

SCHEMA = "doc_id long, text string, lang string, mask int, part string"
LABELS = "doc_id long, quality int, toxic int"


def fails(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    found = "A" if len(words) < 100 else ""
    found += "B" if 100 * len(set(words)) < 80 * len(words) else ""
    found += "C" if 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text) else ""
    return found + ("D" if re.search(r"[#$%&*|]", text) else "")


def by_loops(docs, labels):
    rows = []
    for doc_id, text, lang, *_ in docs:
        text = text or ""
        copy = doc_id is not None and any(t == text and i is not None and i < doc_id for i, t in ((r[0], r[1] or "") for r in docs))
        good = any(i == doc_id and q == 1 for i, q, _ in labels if i is not None)
        toxic = any(i == doc_id and t == 1 for i, _, t in labels if i is not None)
        rows.append((lang or "", fails(text) + ("E" if copy else ""), good, toxic))
    found, sums = [], {}
    for part in {r[0] for r in rows}:
        for order in permutations("ABCDE"):
            left = [r for r in rows if r[0] == part]
            earlier = []
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                unique = sum(r[0] == part and r[1] == f for r in rows)
                found.append([part, "".join(order), step, len(left), len(gone), sum(f in r[1] for r in earlier), unique, sum(r[2] for r in gone), sum(r[3] for r in gone)])
                sums[part, f] = sums.get((part, f), 0) + len(gone)
                earlier += gone
    return sorted((*r, sums[r[0], r[1][r[2] - 1]]) for r in found)


def audited(spark, docs, labels):
    masks = filter_audit.failure_masks(spark.createDataFrame(docs, SCHEMA))
    return sorted(tuple(r) for r in filter_audit.audit(filter_audit.with_labels(masks, spark.createDataFrame(labels, LABELS))).collect())


def test_random_rows(spark):
    r = random.Random(2)
    words = [f"w{i}" for i in range(300)] + ["Ab", "CDEF", "x|y", "100%"]
    texts = [" ".join(r.choice(words[: r.choice((20, 200, 304))]) for _ in range(r.choice((5, 99, 100, 130, 400)))) for _ in range(60)]
    docs = [(i, r.choice(texts), r.choice(("en", "de", None)), 7, "odd") for i in range(150)]
    labels = [(r.randrange(150), r.randrange(2), r.randrange(2)) for _ in range(90)]
    assert audited(spark, docs, labels) == by_loops(docs, labels)


def test_odd_rows(spark):
    long = "ß𝄞 wörter " * 20_000
    docs = [(1, None, None, 0, "p"), (2, "", "", 0, "p"), (2, "", "", 0, "p"), (None, "", "en", 0, "p"), (None, "ABC", "en", 0, "p"), (3, "ABC", "en", 0, "p"), (3, "ABC", "en", 0, "p")]
    docs += [(4, "ABC", None, None, None), (5, long, "en", 0, "p"), (6, " \t\n\x0b\x0c\r  ", "en", 0, "p"), (-7, "a#b", "x", 0, "p")]
    labels = [(3, 1, 1), (3, 0, 0), (None, 1, 1), (5, None, 1), (99, 1, 1)]
    assert audited(spark, docs, labels) == by_loops(docs, labels)


def test_empty_tables(spark):
    assert audited(spark, [], []) == []
    docs = [(1, "a b", "en", 0, "p")]
    assert audited(spark, docs, []) == by_loops(docs, [])
