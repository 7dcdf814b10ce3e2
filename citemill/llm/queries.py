"""The registered queries of the corpus operators and their SQL, for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from citemill.llm.best_fit import op5_best_fit
from citemill.llm.digest_index import op6_digest_index
from citemill.llm.filter_audit import op11_filter_audit
from citemill.llm.hard_negatives import op12_hard_negatives
from citemill.llm.histogram_shards import op2_histogram_shards
from citemill.llm.license_scan import op8_license_scan
from citemill.llm.minhash_dedup import op13_minhash_near_dedup
from citemill.llm.mixing import op9_mixing_tree
from citemill.llm.multiset_hash import op7_multiset_hash
from citemill.llm.secret_ledger import op3_secret_ledger
from citemill.llm.simhash_dedup import op1_simhash_near_dedup
from citemill.llm.toxicity import op4_toxicity
from citemill.llm.warc_revisits import REVISIT_AFTER, op10_warc_revisits

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op2_histogram_shards": op2_histogram_shards,
    "op3_secret_ledger": op3_secret_ledger,
    "op4_toxicity": op4_toxicity,
    "op5_best_fit": op5_best_fit,
    "op6_digest_index": op6_digest_index,
    "op7_multiset_hash": op7_multiset_hash,
    "op8_license_scan": op8_license_scan,
    "op9_mixing_tree": op9_mixing_tree,
    "op10_warc_revisits": op10_warc_revisits,
    "op11_filter_audit": op11_filter_audit,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_minhash_near_dedup": op13_minhash_near_dedup,
}

#: kind -> pattern, the group that has a least length, and that length. A run of one class that is too short holds no
#: later match, so its least length is in the pattern.
_KINDS = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": ("AKIA[A-Z0-9]{16,}", 0, 1),
    "hex": ("[0-9a-f]{24,}", 0, 1),
    "pem": ("-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    "jwt": (r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1),
}
_MATCHES = " UNION ALL ".join(
    f"""SELECT doc_id, '{kind}' AS kind, {n} AS kind_no, {least} AS least, regexp_extract_all(text, '{pattern}', 0) AS whole,
        regexp_extract_all(text, '{pattern}', {group}) AS part, regexp_split_to_array(text, '{pattern}') AS gaps FROM d WHERE regexp_matches(text, '{pattern}')"""
    for n, (kind, (pattern, group, least)) in enumerate(_KINDS.items())
)
#: The audit's filter i, whose bit is 1 << i, at a step of an order; and the bits of those that ran before it.
_BIT = "CAST(1 << (instr('ABCDE', substr(filter_order, step, 1)) - 1) AS int)"
_BEFORE = " + ".join(f"CASE WHEN instr(filter_order, '{f}') < step THEN {1 << i} ELSE 0 END" for i, f in enumerate("ABCDE"))
_JOINED = "string_agg(kind || ':' || s || ':' || (s + n), ',' ORDER BY s, kind_no)"

ORACLE_SQL: dict[str, str] = {
    "op3_secret_ledger": f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), m AS ({_MATCHES}),
        x AS (SELECT *, unnest(range(1, len(whole) + 1)) AS i FROM m),
        y AS (SELECT doc_id, kind, kind_no, len(whole[i]) AS n, list_sum(list_transform(gaps[1:i], lambda g: len(g))) + coalesce(list_sum(list_transform(whole[1:i - 1], lambda w: len(w))), 0) AS s
              FROM x WHERE len(part[i]) >= least),
        z AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS b, count(*) FILTER (kind = 'hex') AS c,
                     {_JOINED} FILTER (kind_no < 3) AS base, {_JOINED} AS spans FROM y GROUP BY doc_id)
        SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
               coalesce(spans, '') AS spans, sha256(text) AS blob FROM d LEFT JOIN z USING (doc_id)
    """,
    "op10_warc_revisits": f"""
        WITH parts AS (SELECT page_id, coalesce(html, '') AS html, length(html) AS n, regexp_replace(regexp_replace(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '#.*$', '') AS bare FROM pages),
        split AS (SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(bare, '^[^/?]*')), '^www[0-9]*\\.', ''), ':(80|443)$', '') || regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '') AS place,
            array_to_string(list_sort(list_filter(string_split(regexp_extract(bare, '\\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '(?i)^(utm_[^=]*|ref|fbclid|gclid|sessionid)(=|$)'))), '&') AS query FROM parts),
        p AS (SELECT page_id, place || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS url_key, '"' || substr(sha1(html), 1, 16) || '"' AS etag, n FROM split),
        r AS (SELECT page_id * 2 + 1 AS record_id, url_key, CAST(page_id + {REVISIT_AFTER} AS double) AS ts, etag, page_id + {REVISIT_AFTER} AS day FROM p)
        SELECT r.record_id, r.url_key, r.ts, f.page_id * 2 AS latest, CASE WHEN f.etag = r.etag THEN f.page_id * 2 END AS refers_to,
               CASE WHEN f.page_id IS NULL THEN 'no-response' WHEN f.etag = r.etag THEN 'resolved' ELSE 'validator-mismatch' END AS status,
               CASE WHEN f.etag = r.etag THEN 'cache-control: max-age=600' || chr(10) || 'content-length: ' || f.n || chr(10) || 'content-type: text/html' || chr(10) || 'date: ' || r.day || chr(10) || 'etag: ' || f.etag END AS headers
        FROM r ASOF LEFT JOIN (SELECT *, CAST(page_id AS double) AS at FROM p) f ON r.url_key = f.url_key AND r.ts > f.at
    """,
    "op6_digest_index": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
    "op11_filter_audit": f"""
        WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        m AS (SELECT part,
                CASE WHEN len(w) < 100 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 2 ELSE 0 END
                + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
                + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END AS mask,
                CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) THEN 1 ELSE 0 END AS good, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN 1 ELSE 0 END AS toxic FROM d),
        c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask),
        o AS (SELECT a || b || c || d || e AS filter_order
              FROM (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS a), (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS b), (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
                   (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS d), (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS e) WHERE len(list_distinct([a, b, c, d, e])) = 5),
        s AS (SELECT *, {_BIT} AS bit, {_BEFORE} AS before FROM o, (SELECT CAST(unnest(range(1, 6)) AS int) AS step)),
        r AS (SELECT part, filter_order, step, bit, sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN n ELSE 0 END) AS removed,
                sum(CASE WHEN mask & before > 0 AND mask & bit > 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
                sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN toxic ELSE 0 END) AS toxic_lost
              FROM c, s GROUP BY part, filter_order, step, bit)
        SELECT part, filter_order, step, CAST(kept AS bigint) AS kept, CAST(removed AS bigint) AS removed, CAST(redundant AS bigint) AS redundant, CAST(unique_fails AS bigint) AS unique_fails,
               CAST(good_lost AS bigint) AS good_lost, CAST(toxic_lost AS bigint) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS bigint) AS shapley FROM r
    """,
    "op12_hard_negatives": """
        WITH r AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS double))) AS v
                   FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        a AS (SELECT * FROM r WHERE vec_id % 100 = 0),
        s AS (SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, CAST(list_inner_product(a.v, r.v) AS bigint) AS score FROM a JOIN r ON a.vec_id IS DISTINCT FROM r.vec_id),
        p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS n FROM s WHERE same) WHERE n <= 5),
        n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS n
              FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score)
        SELECT anchor_id, positive_id, CAST(n AS int) AS rank, negative_id, positive_score, negative_score FROM n WHERE n <= 10
    """,
}
