"""The corpus pipeline against a plain version, stage by stage, over whole tables."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from citemill.llm import queries
from tests.llm.test_shingle_links import kept_by_all_pairs


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    """The rows that each stage got and gave, written and reread."""
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, docs, sf_dir).write.parquet(path)
        given, docs = docs, spark.read.parquet(path)
        out[name] = given, docs
    return out


def test_order_and_columns(stages):
    assert list(stages) == ["toxicity", "exact_dedup", "near_dedup", "mixing", "packing"]
    columns = stages["toxicity"][0].columns
    assert all(given.columns == columns for given, _ in stages.values())


def test_toxic_documents_go(stages, spark, sf_dir):
    kept = {r.doc_id for r in stages["toxicity"][1].collect()}
    wanted = {r.doc_id for r in queries.op4_toxicity(spark, sf_dir).filter("predicted = 0").collect()}
    assert kept == wanted
    toxic = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").filter("toxic = 1").collect()}
    clean = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").filter("toxic = 0").collect()}
    assert len(toxic & kept) < 0.4 * len(toxic) and len(clean & kept) > 0.97 * len(clean)


def test_one_of_each_text_stays(stages):
    given, kept = stages["exact_dedup"]
    best = {}
    for r in given.collect():
        best[r.text] = max(best.get(r.text, -1), r.doc_id)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(best.values())


def test_one_of_each_component_stays(stages):
    given, kept = stages["near_dedup"]
    assert sorted(r.doc_id for r in kept.collect()) == kept_by_all_pairs({r.doc_id: r.text for r in given.collect()})


def test_mix_takes_its_targets(stages):
    """Whole documents, but for the last of each source, of which the first words are taken."""
    given, drawn = ({r.doc_id: r for r in stages["mixing"][0].collect()}, stages["mixing"][1].collect())
    words = {i: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for i, r in given.items()}
    times = Counter(r.doc_id for r in drawn)
    assert set(times) <= set(given) and max(times.values()) <= 3
    cut = [r for r in drawn if r != given[r.doc_id]]
    assert all(given[r.doc_id].text.lstrip().startswith(r.text) for r in cut) and len({r.source for r in cut}) == len(cut)
    sizes, taken = Counter(), Counter()
    for i, r in given.items():
        sizes[r.source] += words[i]
    for r in drawn:
        taken[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    names = sorted(sizes, key=str.encode)
    weights = {s: (5, 2, 1)[n % 3] for n, s in enumerate(names)}
    free, left, target = set(names), float(sum(sizes.values())), {}
    while free:
        share = {s: left * weights[s] / sum(weights[x] for x in free) for s in free}
        full = {s for s in free if share[s] > 3 * sizes[s]}
        target |= share | {s: 3.0 * sizes[s] for s in full}
        left -= sum(3.0 * sizes[s] for s in full)
        free -= full
        if not full:
            break
    assert all(abs(taken[s] - target[s]) <= 1 for s in names)


def test_every_copy_is_packed(stages):
    given, packed = stages["packing"]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    wanted = Counter()
    for r in given.collect():
        n = len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1
        wanted.update((r.doc_id, k, min(4096, n - 4096 * k)) for k in range(-(-n // 4096)))
    rows = packed.collect()
    assert Counter((r.doc_id, r.piece, r.length) for r in rows) == wanted
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(places) <= -(-sum(r.length for r in rows) // 4096) * 1.02 + 1


def test_run_gives_what_the_stages_give(stages, spark, sf_dir):
    whole = corpus_pipeline.run(spark, sf_dir)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, whole.select(columns).collect())) == sorted(map(tuple, stages["packing"][1].select(columns).collect()))


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_rows(name, odd, empty, spark, sf_dir):
    """Nulls, repeated rows, long texts, no rows, and columns with names that stages use themselves."""
    stage = dict(corpus_pipeline.STAGES)[name]
    names = ["score", "digest", "row_key", "size", "target", "quota", "blocks", "starts", "length", "piece", "_size", "key"]
    for rows in (odd, empty):
        given = rows
        for extra in names:
            given = given.withColumn(extra, F.lit("x"))
        found = stage(spark, given, sf_dir)
        if name != "packing":
            assert found.columns == given.columns
        kept = [r.doc_id for r in found.collect()]
        assert set(kept) <= {1, 2, 3, 4, 5, 6, 7, None} and bool(kept) == (rows is odd)
