"""The network's forward pass and the calibration against plain loops."""

import math

import numpy as np

from citemill.llm import toxicity
from citemill.llm.toxicity import CUT, DIM, FILTERS, LANGUAGES, WIDTHS, Network, Scorer, best_threshold, features


def probability(network: Network, words: list[str]) -> float:
    vectors = [sum(network.table[row] for row in features(w)) for w in words]
    pooled, first = [], 0
    for width in WIDTHS:
        for f in range(FILTERS):
            responses = []
            for start in range(len(words)):
                total = 0.0
                for offset in range(width):
                    if start + offset < len(words):
                        total += sum(float(vectors[start + offset][d]) * float(network.filters[first + offset][d][f]) for d in range(DIM))
                responses.append(total)
            pooled.append(max(responses, default=0.0))
        first += width
    z = network.out_bias + sum(max(p + float(b), 0.0) * float(o) for p, b, o in zip(pooled, network.bias, network.out))
    return 1 / (1 + math.exp(-z))


def test_forward_pass():
    network = Network.new(3)
    network.bias += np.linspace(-0.2, 0.2, len(network.bias), dtype="f4")
    r = np.random.default_rng(1)
    texts = [[f"w{r.integers(0, 40)}" for _ in range(n)] for n in (0, 1, 2, 3, 7, 30, 1, 0, 12)]
    found, _ = Scorer(network).judge(texts)
    assert np.allclose(found, [probability(network, t) for t in texts], atol=1e-5)


def test_scores_put_each_language_threshold_on_the_cut():
    network = Network.new(3)
    network.thresholds = [0.2, 0.4, 0.6, 0.8, 0.5]
    texts = [["the", "of", "x"], ["der", "und", "y"], ["les", "est", "z"], ["los", "una", "q"], ["qqq"], []]
    p, spoken = Scorer(network).judge(texts)
    assert [LANGUAGES[n] for n in spoken] == ["en", "de", "fr", "es", "other", "other"]
    scores, _ = Scorer(network).scores(texts)
    for score, raw, language in zip(scores, p, spoken):
        odds = raw / (1 - raw) / (network.thresholds[language] / (1 - network.thresholds[language])) * CUT / (1 - CUT)
        assert abs(score - odds / (1 + odds)) < 1e-5
        assert (score >= CUT) == (raw >= network.thresholds[language])


def test_best_threshold_against_all_cuts():
    r = np.random.default_rng(2)
    for _ in range(20):
        y = (r.random(40) < 0.3).astype(float)
        p = np.clip(0.5 * y + 0.6 * r.random(40), 0.01, 0.99)
        if not 0 < y.sum() < 40:
            continue
        f1 = lambda cut: 2 * ((p >= cut) * y).sum() / max(1, (p >= cut).sum() + y.sum())
        assert f1(best_threshold(p, y)) >= max(f1(c) for c in p) - 1e-9


def test_training_texts_are_one_for_each_id(spark):
    docs = spark.createDataFrame([(n % 10, f"text {n}") for n in range(100)], "doc_id long, text string")
    labels = spark.createDataFrame([(n, n % 2) for n in range(10)], "doc_id long, toxic int")
    rows = toxicity.sample(docs, labels).collect()
    assert len(rows) <= 10 and len({r.text for r in rows}) == len(rows)
