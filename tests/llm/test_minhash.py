"""MinHash near-dedup against the Jaccard similarity of all pairs, by three-word shingles."""

from __future__ import annotations

import random

import numpy as np
import pytest

from citemill.llm import minhash_dedup as minhash


def by_all_pairs(rows):
    sets = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        sets.append({tuple(words[k : k + 3]) for k in range(max(1, len(words) - 2))} if words else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, x in enumerate(sets):
        for b in range(a):
            y = sets[b]
            if x and y and 100 * len(x & y) >= 85 * len(x | y):
                root[find(a)] = find(b)
    ids = {}
    for n, (i, _) in enumerate(rows):
        ids.setdefault(find(n), []).append(i)
    least = {k: min((i for i in v if i is not None), default=None) for k, v in ids.items()}
    found = [(i, len(s), least[find(n)], i == least[find(n)]) for n, ((i, _), s) in enumerate(zip(rows, sets))]
    return sorted(found, key=repr)


def linked(spark, rows, schema="doc_id long, text string"):
    return sorted((tuple(r) for r in minhash.link_documents(spark.createDataFrame(rows, schema)).collect()), key=repr)


def edited(r, text, changes):
    text = list(text)
    for _ in range(changes):
        text[r.randrange(len(text))] = f"x{r.random()}"
    return text


def test_edited_copies_chains_and_shared_passages(spark):
    r = random.Random(3)
    words = lambda n: [f"w{r.randrange(5000)}" for _ in range(n)]
    texts = []
    for n in (1, 2, 3, 7, 9, 30, 90, 300):
        for _ in range(5):
            text = words(n)
            for _ in range(6):
                texts.append(" ".join(text))
                text = edited(r, text, r.randint(1, max(1, n // 60)))
    passage = words(40)
    texts += [" ".join([*passage, *words(r.randint(3, 30))]) for _ in range(80)]
    texts += [texts[5].upper(), texts[5].replace(" ", "\t")]
    r.shuffle(texts)
    rows = list(enumerate(texts))
    assert linked(spark, rows) == by_all_pairs(rows)


def test_a_crowd_on_both_sides_of_the_limit(spark):
    """A bucket of many texts, some near and most of them just not, is completed without forming all of its pairs."""
    r = random.Random(9)
    base = [f"b{i}" for i in range(150)]
    rows = [(i, " ".join(edited(r, base, r.choice((2, 3, 4, 5, 6))))) for i in range(220)]
    wanted = by_all_pairs(rows)
    assert len({c for _, _, c, _ in wanted}) > 50
    assert linked(spark, rows) == wanted


def test_shortest_near_sets(spark):
    """The fewest shingles at which different sets can be near: 6 of 7, and 17 of 20."""
    rows = []
    for k in range(40):
        words = [f"k{k}w{i}" for i in range(22)]
        rows += [(4 * k, " ".join(words[:9])), (4 * k + 1, " ".join(words[:8])), (4 * k + 2, " ".join(words)), (4 * k + 3, " ".join(words[:19]))]
    assert linked(spark, rows) == by_all_pairs(rows)


def test_odd_rows(spark, odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    found = sorted((tuple(r) for r in minhash.link_documents(odd).collect()), key=repr)
    assert found == by_all_pairs([(i, t) if t and t.split() else (i, None) for i, t in rows])
    assert minhash.link_documents(empty).count() == 0
    assert linked(spark, [(None, "a b c d"), (None, "a b c d")]) == [(None, 2, None, True)] * 2


def test_bounds_of_the_posterior():
    """Pruned pairs have a posterior chance below the chosen miss, by summing the Beta density; others don't."""
    steps = (np.arange(200_000) + 0.5) / 200_000
    for n, least in minhash.fewest_agreements(0.85):
        def chance(m, n=n):
            density = np.exp(m * np.log(steps) + (n - m) * np.log1p(-steps))
            return density[steps >= 0.85].sum() / density.sum()

        assert least == 0 or chance(least - 1) < minhash.MISS
        assert chance(least) >= 0.99 * minhash.MISS
    # The chance that a pair at the limit is ever pruned is below one in a million, and that it shares no band too.
    r = np.random.default_rng(1)
    agreed = np.cumsum(r.random((300_000, minhash.HASHES)) < 0.85, axis=1)
    assert not any((agreed[:, n - 1] < least).any() for n, least in minhash.fewest_agreements(0.85))
    assert (1 - 0.85**minhash.ROWS) ** minhash.BANDS < 1e-6


def test_signatures_agree_as_often_as_sets_do():
    r = np.random.default_rng(5)
    rates = []
    for _ in range(200):
        both, one, two = (r.integers(-(1 << 63), 1 << 63, n, dtype=np.int64) for n in (85, 8, 7))
        rates.append((minhash.signature(np.concatenate([both, one])) == minhash.signature(np.concatenate([both, two]))).mean())
    assert np.mean(rates) == pytest.approx(0.85, abs=0.01)
