"""Token ids of the encoder against the tokenizer itself, over letters of all scripts and random mixed texts."""

import random
import unicodedata
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.models import WordLevel
from tokenizers.pre_tokenizers import WhitespaceSplit

from citemill.llm import best_fit
from citemill.llm.common import written


@pytest.fixture(scope="module")
def encoder():
    return best_fit.WordEncoder(public_tokenizers.path(best_fit.TOKENIZER))


def differing(encoder, texts):
    """The texts for which the encoder and the tokenizer differ."""
    expected = encoder.tokenizer.encode_batch(texts, add_special_tokens=False)
    return [t for t, e in zip(texts, expected) if np.frombuffer(encoder.encode(t), dtype="<u4").tolist() != e.ids]


def test_every_letter_before_punctuation(encoder):
    letters = [chr(n) for n in range(0x20, 0x30000) if chr(n).isalnum() and not 0xAC00 <= n < 0xD700 and not 0x3400 <= n < 0xA000 and n < 0x20000]
    for end in (".", "'s", "!?", "_"):
        assert not differing(encoder, [f"a{c}{end}" for c in letters])
    sample = letters[::40]
    assert not differing(encoder, [f"{c}{chr(p)}" for c in sample for p in range(33, 127)])


def test_random_mixed_texts(encoder):
    r = random.Random(3)
    marks = [chr(n) for n in range(0x300, 0x340)]
    spaces = [" ", "\t", "\n", " ", " ", "　", "\x1c", "\x85", "​"]
    letters = [chr(n) for n in range(0x20, 0x2FFF) if unicodedata.category(chr(n)) not in ("Cn", "Cs", "Co")]
    pools = [list("abcdeABC"), list("0123456789"), list(".,'!?-_<|>\"()"), marks, spaces, letters, list("éÀßİıſKÅ")]
    texts = ["".join(r.choice(r.choice(pools)) for _ in range(r.randint(0, 40))) for _ in range(20_000)]
    assert not differing(encoder, texts + ["<|endoftext|> a<|startoftext|>.", "İ.", "क़!", "x́.", "don't they're I'LL '' 's"])


def test_common_words_are_encoded_once_beside_many_rare_ones(monkeypatch):
    monkeypatch.setattr(best_fit, "MEMORY_WORDS", 100)
    encoder = best_fit.WordEncoder(public_tokenizers.path(best_fit.TOKENIZER))
    asked, model, r = Counter(), encoder.model, random.Random(5)

    class Counting:
        def tokenize(self, word):
            asked[word] += 1
            return model.tokenize(word)

    encoder.model = Counting()
    common = ["these", "words", "come", "again", "and", "over"]
    rare = ["".join(r.choices("abcdefghij", k=9)) for _ in range(1500)]
    texts = [" ".join([*common, *rare[n : n + 30], *(f"{w.title()}," for w in common)]) for n in range(0, len(rare), 30)]
    assert not differing(encoder, texts)
    assert {asked[w] for w in common} == {1}


def test_runs_of_texts_and_long_ones(encoder, monkeypatch):
    monkeypatch.setattr(best_fit, "TOGETHER", 40)
    texts = ["", "One, two. Three!", " \n ", "it'S --'s v2.10" * 9, "\u201cquoted\u201d", "", "caf\u00e9... \u00c9T\u00c9; n\u00ba 5\u00bd", "x" * 500 + ".", "A<|endoftext|>, <|STARTOFTEXT|>", "\u0394\u039f\u03a3. a\u0338, \u2026,", ""]
    expected = [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    for kind in (pa.string(), pa.large_string()):
        assert [np.frombuffer(ids, dtype="<u4").tolist() for ids in encoder.of_each(pa.array([*texts, "cut"], kind).slice(0, len(texts)))] == expected
    assert list(encoder.of_each(pa.array([], pa.string()))) == [] and list(encoder.of_each(pa.array(["", " "]))) == [b"", b""]


def test_words_of_a_tokenizer_that_keeps_case(tmp_path):
    cased = Tokenizer(WordLevel({"?": 0, "Two": 1, "two": 2, ",": 3, "Two,": 4}, unk_token="?"))
    cased.pre_tokenizer = WhitespaceSplit()
    cased.save(str(tmp_path / "cased.json"))
    encoder = best_fit.WordEncoder(str(tmp_path / "cased.json"))
    assert not differing(encoder, ["Two two Two, two, three", ""])


def test_repeated_rows_are_dealt_out(spark):
    rows = spark.range(3000).select(F.lit(1).alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), F.lit(1500).cast("long").alias("length"), F.lit(5).cast("long").alias("ids_crc32"))
    packed = written(best_fit.pack(rows, lot_rows=100), "packed")
    lots = [r[0] for r in packed.groupBy((F.shiftright("sequence_id", 36)).alias("lot")).count().select("count").collect()]
    assert len(lots) == 30 and max(lots) < 200
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 4096").isEmpty()
