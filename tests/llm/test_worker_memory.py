"""What a Python worker holds while it scores, and after it has packed."""

import tracemalloc
import weakref

import numpy as np
import public_tokenizers
import pyarrow as pa

from citemill.llm import best_fit, shingle_links, toxicity


class Given:
    """Stands for a table: hands its batches to the function of a task, in this process."""

    def __init__(self, *batches: pa.RecordBatch):
        self.batches, self.found = batches, None

    def select(self, *_):
        return self

    def mapInArrow(self, run, _):
        self.found = list(run(iter(self.batches)))
        return self


def test_other_tasks_let_the_encoder_go():
    path = public_tokenizers.path(best_fit.TOKENIZER)
    encoder = best_fit.encoder_of(path)
    assert best_fit.encoder_of(path) is encoder
    there = weakref.ref(encoder)
    del encoder
    given = Given(pa.RecordBatch.from_arrays([pa.array(["a b c d e f"])], names=["text"]))
    shingle_links._sets(given, 5)
    assert given.found[0].num_rows == 1 and there() is None


def test_scoring_holds_a_bounded_share_of_words():
    """256 texts of 430 words at a time, 140,000 different words in all."""
    scorer = toxicity.Scorer(toxicity.Network.new())
    texts = [[f"w{n * n % 140_009}" for n in range(at, at + 430)] for at in range(0, 430 * 1024, 430)]
    tracemalloc.start()
    try:
        scores = [scorer.scores(texts[at : at + 256])[0] for at in range(0, len(texts), 256)]
        peak = tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()
    print(f"peak {peak:.0f} MB")
    assert peak < 45
    alone = toxicity.Scorer(scorer.network)
    assert np.allclose(np.concatenate(scores)[::100], [alone.scores([t])[0][0] for t in texts[::100]])
