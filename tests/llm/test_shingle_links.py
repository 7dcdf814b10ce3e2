"""The near_dedup stage against the Jaccard similarity of all pairs, by five-word shingles."""

from __future__ import annotations

import random

import corpus_pipeline
import numpy as np

from citemill.llm import shingle_links
from citemill.llm.common import written


def kept_by_all_pairs(texts):
    sets = {}
    for i, text in texts.items():
        words = (text or "").encode().lower().split()
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if 5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)) and 5 * len(x & y) >= 4 * len(x | y):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return sorted({find(i) for i in ids})


def test_stage_on_the_table(spark, sf_dir, documents):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    wanted = kept_by_all_pairs({i: r.text for i, r in documents.items()})
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, sf_dir).collect()) == wanted


def test_edited_copies_chains_and_a_crowd(spark, sf_dir):
    """Copies with words changed, on both sides of the limit; chains of such; a crowd that shares most shingles; and
    texts whose common lines are in all of them."""
    r = random.Random(3)
    words = lambda n: [f"w{r.randrange(5000)}" for _ in range(n)]
    texts = []
    for n in (1, 4, 5, 6, 9, 12, 30, 90, 300):
        for _ in range(6):
            text = words(n)
            for _ in range(6):
                texts.append(" ".join(text))
                text = list(text)
                for _ in range(r.randint(1, max(1, n // 40))):
                    text[r.randrange(n)] = f"x{r.random()}"
    base = words(200)
    for _ in range(150):
        text = list(base)
        text[r.randrange(200)], text[r.randrange(200)] = f"y{r.random()}", f"y{r.random()}"
        texts.append(" ".join(text))
    line = words(40)
    texts += [" ".join([*line, *words(r.randint(3, 30))]) for _ in range(100)]
    r.shuffle(texts)
    found = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), sf_dir)
    assert sorted(x.doc_id for x in found.collect()) == kept_by_all_pairs(dict(enumerate(texts)))


def test_shortest_near_sets(spark, sf_dir):
    """4 of 5 shingles are near whatever the fingerprints; among many such pairs some differ in 25 bits and more."""
    r = random.Random(12)
    rows = [(0, "wba13cd2816 w43184a6c2a w3ad43b8083 w4885f01fc8 wd5d9b3157b wf214c0f9ab w5c955d6a66 w227a2bb366 w91ce7cb7ef")]
    rows += [(2 * k, " ".join(f"w{r.getrandbits(40):x}" for _ in range(9))) for k in range(1, 3000)]
    rows += [(i + 1, text.rpartition(" ")[0]) for i, text in rows]
    found = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), sf_dir)
    assert sorted(x.doc_id for x in found.collect()) == list(range(0, 6000, 2))


def test_a_crowd_just_short_of_similar(spark, sf_dir):
    """1,400 texts that share a base and are near in few pairs: all links are found, and far fewer pairs are read than there are."""
    r = random.Random(13)
    base = [f"b{i}" for i in range(150)]
    texts = []
    for _ in range(1400):
        text = list(base)
        for at in r.sample(range(0, 150, 6), 4):
            text[at + r.randrange(5)] = f"y{r.random()}"
        texts.append(" ".join(text))
    docs = written(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "test")
    read = []
    near = shingle_links.Verifier.near
    try:
        shingle_links.Verifier.near = lambda self, pairs: (read.append(pairs.count()), near(self, pairs))[1]
        found = corpus_pipeline.drop_near_copies(spark, docs, sf_dir)
    finally:
        shingle_links.Verifier.near = near
    assert sorted(x.doc_id for x in found.collect()) == kept_by_all_pairs(dict(enumerate(texts)))
    assert sum(read) < 1400 * 1399 / 2 / 10


def test_parities_never_exceed_the_tokens_apart():
    r = np.random.default_rng(3)
    for n in (1, 5, 200, 256, 257, 700, 5000):
        for _ in range(20):
            both, one, two = (np.unique(r.integers(-(1 << 63), 1 << 63, k, dtype=np.int64)) for k in (n, r.integers(0, n // 4 + 1), r.integers(0, n // 4 + 1)))
            x, y = (shingle_links.parity(np.unique(np.concatenate([both, part]))) for part in (one, two))
            while len(x) != len(y):
                longer, shorter = (x, y) if len(x) > len(y) else (y, x)
                x, y = longer[: len(longer) // 2] ^ longer[len(longer) // 2 :], shorter
            assert int(np.bitwise_count((x ^ y).view("<u8")).sum()) <= len(one) + len(two)
