"""Nulls, empty and long texts, ties, repeated rows, empty tables and columns with the operators' own names."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from citemill.llm import best_fit, digest_index, histogram_shards, license_scan, mixing, multiset_hash, secret_ledger, simhash_dedup, toxicity, warc_revisits
from citemill.operators.graph import link_components
from citemill.llm.common import written


def ids(df, column="doc_id"):
    return sorted((r[column] for r in df.collect()), key=lambda x: (x is None, x))


EVERY_ID = [1, 2, 2, 3, 4, 5, 6, 7, None, None]


def test_simhash_rows(odd, empty):
    rows = simhash_dedup.link_documents(odd).collect()
    assert sorted((r.doc_id for r in rows), key=lambda x: (x is None, x)) == EVERY_ID
    by_id = {r.doc_id: r for r in rows if r.doc_id}
    assert by_id[1].component_id == by_id[2].component_id == 1 and by_id[1].component_size == 3
    assert by_id[3].fp == by_id[4].fp == by_id[5].fp == 0 and by_id[5].component_id == 3
    kept = simhash_dedup.deduplicate(odd)
    assert kept.columns == odd.columns and ids(kept) == [1, 3, 6, 7, None]
    assert simhash_dedup.link_documents(empty).count() == simhash_dedup.deduplicate(empty).count() == 0


def test_simhash_links_against_all_pairs(spark):
    """Random fingerprints, families around centres, and one crowd larger than any cell compares in pairs."""
    r = random.Random(5)
    prints = {r.getrandbits(64) for _ in range(300)}
    for centre in [r.getrandbits(64) for _ in range(30)]:
        for _ in range(6):
            prints.add(centre ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)))
    crowd = r.getrandbits(64)
    prints |= {crowd ^ (1 << a) ^ (1 << b) for a in range(24) for b in range(24)}
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    table = written(spark.createDataFrame([(p,) for p in signed], "fp long"), "test")
    links = [(r.a, r.b) for r in simhash_dedup.near_links(table).collect()]
    assert all(((a ^ b) & (2**64 - 1)).bit_count() <= 2 for a, b in links)
    found = {r.node: r.root for r in link_components(spark.createDataFrame(links, "a long, b long")).collect()}
    root = {p: p for p in signed}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, a in enumerate(signed):
        for b in signed[n + 1 :]:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert all(found.get(p, p) == find(p) for p in signed)


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(1000, 1001)], "a long, b long")
    found = {r.node: r.root for r in link_components(links).collect()}
    assert found == {i: 0 for i in range(201)} | {1000: 1000, 1001: 1000}


def test_shards(odd, empty, spark):
    rows = histogram_shards.shard_by_bytes(odd, 4)
    assert ids(rows) == EVERY_ID and histogram_shards.shard_by_bytes(empty, 4).count() == 0
    found = rows.collect()
    assert all(r["size"] == 8 and r.text_crc32 == 0 for r in found if r.doc_id in (3, 4))
    slots = defaultdict(list)
    for r in found:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    # A third of the rows have one text: it is cut; the others' equal texts stay together.
    many = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot " * 20).otherwise(F.concat(F.lit("text "), (F.col("id") / 4).cast("int").cast("string"))).alias("text"))
    placed = histogram_shards.shard_by_bytes(many, 8).join(many, "doc_id")
    sizes = [r[0] for r in placed.groupBy("shard").agg(F.sum("size")).select("sum(size)").collect()]
    assert len(sizes) == 8 and max(sizes) - min(sizes) <= 0.03 * sum(sizes) / 8
    assert placed.filter("text not like 'hot%'").groupBy("text").agg(F.count_distinct("shard").alias("n")).filter("n > 1").count() <= 1


def test_ledger_scans_only_what_is_new(odd, empty, spark):
    ledger = secret_ledger.BlobLedger(spark)
    first = ledger.scan(odd, "doc_id", rule_versions={1: secret_ledger.BASE_RULES})
    assert ids(first, "path") == EVERY_ID
    pairs = ledger.findings().count()
    assert pairs == odd.select(F.coalesce("text", F.lit(""))).distinct().count()
    ledger.scan(odd, "doc_id", rule_versions={1: secret_ledger.BASE_RULES})
    assert ledger.findings().count() == pairs
    more = odd.union(spark.createDataFrame([(9, "a token=zzzzzzzz -----BEGIN PRIVATE KEY-----", "s", 1)], odd.schema))
    found = {r.path: r.spans for r in ledger.scan(more, "doc_id").collect()}
    assert ledger.findings().count() == 2 * (pairs + 1)
    assert [(s.kind, s.start, s.end) for s in found[9]] == [("assign", 2, 16), ("pem", 17, 44)]
    assert len(found[6]) == 3000 and found[6][1].start - found[6][0].start == len("é𝄞 token=abcdefgh secret: 'xy' ")
    assert secret_ledger.BlobLedger(spark).scan(empty, "doc_id").count() == 0


@pytest.mark.parametrize("text,spans", [("secret=token: abcdefgh", []), ("API_KEY = 'ab/cd+ef' x", [(0, 19)]), ("PaSsWd:\"12345\"", []), ("AKIA" * 5, []), ("xAKIA" + "A" * 16, []), ("a" * 23, []), ("ga" + "0" * 23 + "g", [])])
def test_assign_rule(spark, text, spans):
    found = spark.range(1).select(secret_ledger.rule_spans(F.lit(text), secret_ledger.BASE_RULES[0]).alias("s")).first().s
    assert [(s.start, s.end) for s in found] == spans


def test_digest_index(odd, empty):
    for keep, best in (("largest", 2), ("smallest", 1)):
        rows = digest_index.resolve(odd, keep).collect()
        assert sorted((r.doc_id for r in rows), key=lambda x: (x is None, x)) == EVERY_ID
        assert {r.keep_id for r in rows if r.doc_id in (1, 2)} == {best}
        assert {r.keep_id for r in rows if r.doc_id in (3, 4)} == {4 if keep == "largest" else 3}
    kept = digest_index.deduplicate(odd)
    assert kept.columns == odd.columns and ids(kept) == [2, 4, 5, 6, 7, None]
    assert digest_index.resolve(empty).count() == digest_index.deduplicate(empty).count() == 0


def test_digest_collisions_never_join_texts(odd, spark):
    weak = digest_index.DigestIndex(spark, digest=lambda text: F.substring(F.sha2(text.cast("binary"), 256), 1, 0))
    rows = {(r.doc_id, r.keep_id, r.group_size) for r in digest_index.resolve(odd, "largest", index=weak).collect()}
    assert rows == {(r.doc_id, r.keep_id, r.group_size) for r in digest_index.resolve(odd, "largest").collect()}


def test_index_merges_runs(odd, spark):
    index = digest_index.DigestIndex(spark)
    index.append(odd.limit(4))
    index.compact()
    index.append(odd)
    found = {r.digest: (r.min_id, r.max_id, r.rows) for r in index.compact().collect()}
    index.append(odd)
    looked = index.lookup(odd).filter("doc_id = 1").first()
    assert (looked.min_id, looked.max_id) == (1, 2) and looked.rows > found[looked.digest][2]


def test_multiset_is_homomorphic(odd, empty, spark):
    texts = {"a": "One here. Two.", "b": "Three\nfour", "both": "One here. Two.\nThree\nfour", "swapped": "four\nTwo.\nThree\nOne here.", "none": ""}
    table = spark.createDataFrame(list(texts.items()), "name string, text string")
    table = written(table.withColumn("v", multiset_hash.multiset_sum("text")), "test")
    sides = {n: table.filter(F.col("name") == n).select(F.col("v").alias(n)) for n in texts}
    row = written(sides["a"].join(sides["b"]).join(sides["both"]).join(sides["swapped"]).join(sides["none"]), "test")
    s = multiset_hash.as_string
    row = written(row.select("*", multiset_hash.combine("a", "b").alias("c"), multiset_hash.combine("both", "b", -1).alias("d"), *[multiset_hash.lanes(n).alias(f"{n}_lanes") for n in texts]), "test")
    near = lambda x, y: multiset_hash.likeness(x, y, f"{x}_lanes", f"{y}_lanes")
    row = row.select(s("c").alias("sum"), s("both").alias("both"), s("swapped").alias("swapped"), s("d").alias("rest"), s("a").alias("a"), near("a", "b").alias("far"), near("both", "a").alias("near"), near("none", "none").alias("none")).first()
    assert row["sum"] == row.both == row.swapped and row.rest == row.a
    assert row.far < 0.35 < row.near < 1 and row.none == 1
    assert ids(multiset_hash.with_next(odd)) == EVERY_ID and multiset_hash.with_next(empty).count() == 0
    long = spark.createDataFrame([(1, "word.\n" * 40000), (2, "a")], "doc_id long, text string")
    assert multiset_hash.with_next(long).select(s("vector")).count() == 2


def test_next_document_across_ranges(spark):
    docs = spark.range(3500).select((F.col("id") * F.col("id")).alias("doc_id"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))
    found = {r.text: r.next_text for r in multiset_hash.with_next(docs).select("text", "next_text").collect()}
    assert found == {f"t{i}": f"t{(i + 1) % 3500}" for i in range(3500)}


def test_mixing(odd, empty):
    rows = mixing.mix(odd)
    assert ids(rows) == EVERY_ID and rows.columns[:4] == odd.columns and mixing.mix(empty).count() == 0
    assert all(r._mix_times <= 3 for r in rows.collect())
    assert mixing.drawn(odd).count() == sum(r._mix_times for r in rows.collect())


def test_tree_keeps_quotas(spark):
    quotas = spark.createDataFrame([("a", 1000), ("b", 7), (None, 300), ("z", 0)], "source string, quota int")
    for shards in (1, 5, 16):
        found = {r.source: r.starts for r in mixing.split_quotas(quotas, shards).collect()}
        assert {s: x[-1] for s, x in found.items()} == {"a": 1000, "b": 7, None: 300, "z": 0}
        totals = Counter()
        for starts in found.values():
            assert len(starts) == shards + 1 and starts == sorted(starts)
            for k in range(shards):
                totals[k] += starts[k + 1] - starts[k]
        assert max(totals.values()) - min(totals.values()) <= (shards - 1).bit_length()


def test_packing(odd, empty):
    rows = best_fit.pack_documents(odd)
    assert ids(rows.filter("piece = 0")) == EVERY_ID and best_fit.pack_documents(empty).count() == 0
    assert {r.length for r in rows.filter("doc_id in (3, 4, 5)").collect()} == {1}
    with_names = odd.withColumn("length", F.lit("x")).withColumn("piece", F.lit(1))
    assert best_fit.pack_documents(with_names).count() == rows.count()


def test_best_fit_takes_the_tightest_bin():
    r = random.Random(2)
    lengths = sorted((r.randint(1, 100) for _ in range(500)), reverse=True)
    left, wanted = [], []
    for n in lengths:
        fits = [(room, i) for i, room in enumerate(left) if room >= n]
        if fits:
            room = min(fits)[0]
        else:
            left.append(100)
            room = 100
        wanted.append(100 - room)
        left[next(i for i, x in enumerate(left) if x == room)] -= n
    assert [offset for _, offset in best_fit.best_fit(lengths, 100)] == wanted


@pytest.mark.parametrize("text", ["<|endoftext|> a<|endoftext|>b", "it's they'll x's.", "É́ é ﬁ x́*** ab²** ΟΔΟΣ. İstanbul, ǅ", "a\x1cb c\x85d e", "'s 't''' ...'s don't'", "_a__ b_", "", "日本語。テスト！ ½ ٣"])
def test_words_are_encoded_as_texts_are(text):
    encoder = best_fit.WordEncoder(public_tokenizers.path(best_fit.TOKENIZER))
    assert np.frombuffer(encoder.encode(text), dtype="<u4").tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def test_toxicity_without_labels_and_odd_rows(odd, empty, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.fit(odd, labels) is None
    assert {r.score for r in toxicity.score(odd, None).collect()} == {0.0}
    some = spark.createDataFrame([(i, 1, int(i in (1, 2))) for i in range(8)], labels.schema)
    network = toxicity.fit(odd, some, epochs=1)
    rows = toxicity.score(odd, network)
    assert ids(rows) == EVERY_ID and toxicity.score(empty, network).count() == 0
    assert len({r.score for r in rows.filter("doc_id in (3, 4, 5)").collect()}) == 1
    assert toxicity.keep_clean(odd, network).columns == odd.columns


def test_pooling_does_not_cross_texts():
    network = toxicity.Network.new()
    words = ["a", "b", "c", "d", "e"]
    apart = np.concatenate([toxicity.Scorer(network).judge([t])[0] for t in (words[:2], [], words[2:])])
    assert np.allclose(toxicity.Scorer(network).judge([words[:2], [], words[2:]])[0], apart)


def test_licenses(odd, empty):
    assert license_scan.find_licenses(odd).count() == license_scan.find_licenses(empty).count() == 0
    scanner = license_scan.Scanner()
    notice = "Released under the MIT License."
    text = f"the {'the word ' * 3000}{notice} and {'more ' * 200}{notice}\n" + license_scan.TEMPLATES["mit"].replace("without restriction", "with no restriction")
    found = scanner.scan(text)
    assert [(f.license, f.coverage == 1.0) for f in found] == [("mit-notice", True), ("mit-notice", True), ("mit", False)]
    assert text[found[0].start : found[0].end] == notice[:-1]
    assert scanner.scan("license " * 5000) == []


@pytest.mark.parametrize("a,b,wanted", [("a b c d", "a x c d", 3), ("x y z", "a b c", 0), ("a a b", "a b", 2), ("", "a", 0)])
def test_alignment(a, b, wanted):
    pairs = license_scan.align(a.split(), b.split())
    assert len(pairs) == wanted and all(x < y and p < q for (x, p), (y, q) in zip(pairs, pairs[1:]))


RECORD = "url_key string, ts double, record_id long, kind string, etag string, last_modified string, digest string, headers map<string,string>"


def test_revisits(spark):
    data = [
        ("u", 1.0, 1, "response", '"a"', None, None, {"ETag": '"a"', "X": "1"}),
        ("u", 5.0, 2, "response", '"b"', None, None, None),
        ("u", 5.0, 3, "revisit", 'W/"a"', None, None, {"Date": "d", "X": "2", "Expires": None}),
        ("u", 6.0, 4, "revisit", '"b"', None, None, None),
        ("u", 0.5, 5, "revisit", '"a"', None, None, {}),
        (None, 9.0, 6, "revisit", None, None, None, {}),
        ("v", None, 7, "revisit", None, None, None, {}),
        ("w", 1.0, 8, "response", None, "Mon", "d1", {}),
        ("w", 2.0, 9, "revisit", None, "Mon", "d2", {}),
        ("w", 2.0, 10, "revisit", '"x"', "Mon", None, {}),
    ]
    found = {r.record_id: (r.status, r.refers_to, r.headers) for r in warc_revisits.resolve(spark.createDataFrame(data, RECORD)).collect()}
    assert found == {
        3: ("resolved", 1, {"etag": '"a"', "x": "1", "date": "d"}),
        4: ("resolved", 2, {}),
        5: ("no-response", None, None),
        6: ("no-response", None, None),
        7: ("no-response", None, None),
        9: ("validator-mismatch", None, None),
        10: ("resolved", 8, {}),
    }
    assert warc_revisits.resolve(spark.createDataFrame([], RECORD)).count() == 0


@pytest.mark.parametrize("url,key", [("HTTPS://www.Example.com:443/a/?utm_source=f&b=2&a=1#top", "example.com/a?a=1&b=2"), ("http://m.x.org/A?ref=z", "m.x.org/A"), ("x.org", "x.org")])
def test_canonical_urls(spark, url, key):
    assert spark.range(1).select(warc_revisits.canonical_url(F.lit(url))).first()[0] == key
