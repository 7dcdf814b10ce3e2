"""Resolution of WARC revisit records (answers 304, not modified).

Every revisit is joined as of its time to the latest earlier full response with the same canonical URL. Its validators
are checked against that response; where they agree, the stored response's headers are merged with those of the 304
that a cache may update.

The as-of join is by windows: within a URL's captures of one stretch of time the last full response is carried forward,
and what each stretch ends with is carried on to later ones. So a URL with any number of captures is many small
windows. Records without URL or time never enter a window.

Defined results: a revisit without URL or time is resolved to nothing (status "no-response"), whatever responses lack them
too; responses at a revisit's
own time don't count as earlier; of several at one time the one with the largest record_id is the latest; repeated rows
are resolved each on its own; an empty table gives an empty table.
"""

from __future__ import annotations

from math import isfinite

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citemill.llm.common import read_table, written

#: Stretches of time, of about the same number of records.
STRETCHES = 512
#: Header fields that a 304 may carry to update a stored response (RFC 9110, 15.4.5), and Expires' kin.
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "vary", "last-modified", "age", "warning"]
#: Query parameters that don't select content.
TRACKING = r"(?i)^(utm_[^=]*|ref|fbclid|gclid|sessionid)(=|$)"


def canonical_url(url: Column) -> Column:
    """Host and path as one key: no scheme, www., default port, fragment, tracking parameter or final slash; the host in lower case."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://", ""), "#.*$", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, r"^[^/?]*", 0)), r"^www\d*\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.rlike(p, F.lit(TRACKING)))), "&")
    return F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit("")))


def _stretches(records: DataFrame) -> DataFrame:
    """records with stretch, the number of the stretch of time they are in. Stretches are cut by counts, at quantiles of all times, so
    each holds about one in STRETCHES records, of one URL or of many, wherever single times lie. Without a time: null."""
    shares = [n / STRETCHES for n in range(1, STRETCHES)]
    cuts = records.agg(F.percentile_approx(F.col("ts").cast("double"), shares, 20 * STRETCHES).alias("cuts")).first()["cuts"] or []
    splits = [-float("inf"), *sorted({c for c in cuts if isfinite(c)}), float("inf")]
    if len(splits) < 3:
        return records.withColumn("stretch", F.when(F.col("ts").isNotNull(), 0))
    at = "_citemill_ts"
    found = Bucketizer(splits=splits, inputCol=at, outputCol="stretch", handleInvalid="keep").transform(records.withColumn(at, F.col("ts").cast("double")))
    return found.withColumn("stretch", F.when(F.col("ts").isNotNull(), F.col("stretch").cast("int"))).drop(at)


def as_of(records: DataFrame) -> DataFrame:
    """The revisits among records, each with full, the struct of the latest earlier response (null if there is none).

    records: url_key, ts (a number), record_id, kind ("response" or "revisit"), etag, last_modified, digest, headers.
    """
    stretch = _stretches(records)
    full = F.when(F.col("kind") == "response", F.struct("record_id", "ts", "etag", "last_modified", "digest", "headers"))
    rows = written(stretch.withColumn("own", full), "records")
    # Revisits come before responses of the same time, so these don't count as earlier.
    inside = Window.partitionBy("url_key", "stretch").orderBy("ts", F.when(F.col("kind") == "response", 1).otherwise(0), "record_id").rowsBetween(Window.unboundedPreceding, -1)
    has_key = F.col("url_key").isNotNull() & F.col("ts").isNotNull()
    keyed = rows.filter(has_key)
    apart = rows.filter(~has_key & (F.col("kind") == "revisit")).withColumn("full", F.lit(None).cast(rows.schema["own"].dataType))
    carried = keyed.withColumn("here", F.last("own", ignorenulls=True).over(inside)).filter("kind = 'revisit'")
    ends = keyed.filter("kind = 'response'").groupBy("url_key", "stretch").agg(F.max_by("own", F.struct("ts", "record_id")).alias("own"))
    wanted = carried.filter("here is null").select("url_key", "stretch").distinct()
    asked = wanted.select("url_key", "stretch", F.lit(None).cast(rows.schema["own"].dataType).alias("own"), F.lit(0).alias("is_end"))
    marks = ends.withColumn("is_end", F.lit(1)).unionByName(asked)
    before = Window.partitionBy("url_key").orderBy("stretch", "is_end").rowsBetween(Window.unboundedPreceding, -1)
    earlier = marks.withColumn("earlier", F.last("own", ignorenulls=True).over(before)).filter("is_end = 0").select("url_key", "stretch", "earlier")
    joined = carried.join(earlier, ["url_key", "stretch"], "left")
    found = joined.withColumn("full", F.coalesce("here", "earlier")).drop("own", "here", "earlier", "stretch")
    return found.unionByName(apart.drop("own", "stretch"))


def resolve(records: DataFrame) -> DataFrame:
    """One row per revisit: record_id, url_key, ts, refers_to, status and headers.

    status: "resolved"; "no-response" without an earlier response; "validator-mismatch" where an etag (weak ones compare
    alike), or else a Last-Modified or payload digest, is given on both sides and differs.
    """
    pair = as_of(records)
    plain = lambda c: F.regexp_replace(c, "^W/", "")
    differs = lambda a, b: F.coalesce(a != b, F.lit(False))
    full = F.col("full")
    has_tags = F.col("etag").isNotNull() & full["etag"].isNotNull()
    mismatch = F.when(has_tags, plain(F.col("etag")) != plain(full["etag"])).otherwise(differs(F.col("last_modified"), full["last_modified"]) | differs(F.col("digest"), full["digest"]))
    status = F.when(full.isNull(), "no-response").when(mismatch, "validator-mismatch").otherwise("resolved")
    permitted = F.map_filter(F.coalesce("headers", F.create_map().cast("map<string,string>")), lambda k, v: F.lower(k).isin(PERMITTED) & v.isNotNull())
    lowered = lambda m: F.transform_keys(m, lambda k, v: F.lower(k))
    new = lowered(permitted)
    old = F.map_filter(lowered(F.coalesce(full["headers"], F.create_map().cast("map<string,string>"))), lambda k, v: ~F.array_contains(F.map_keys(new), k))
    rows = pair.withColumn("status", status)
    merged = F.when(F.col("status") == "resolved", F.map_concat(old, new))
    return rows.select("record_id", "url_key", "ts", F.when(F.col("status") == "resolved", full["record_id"]).alias("refers_to"), full["record_id"].alias("latest"), "status", merged.alias("headers"))


def crawl_records(pages: DataFrame) -> DataFrame:
    """WARC records of a crawl that takes each page once in full, at the time of its page_id, and asks for it again
    REVISIT_AFTER later, with the validators of its own response; the answer is 304."""
    key = canonical_url(F.col("url"))
    digest = F.sha1(F.coalesce("html", F.lit("")).cast("binary"))
    etag = F.concat(F.lit('"'), F.substring(digest, 1, 16), F.lit('"'))
    base = pages.select(F.col("page_id"), key.alias("url_key"), digest.alias("digest"), etag.alias("etag"), F.length("html").alias("length"))
    response = F.struct(
        (F.col("page_id") * 2).alias("record_id"), F.col("page_id").cast("double").alias("ts"), F.lit("response").alias("kind"), F.col("digest"),
        F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("Content-Length"), F.col("length").cast("string"), F.lit("ETag"), F.col("etag"), F.lit("Date"), F.col("page_id").cast("string")).alias("headers"),
    )
    again = F.col("page_id") + REVISIT_AFTER
    revisit = F.struct(
        (F.col("page_id") * 2 + 1).alias("record_id"), again.cast("double").alias("ts"), F.lit("revisit").alias("kind"), F.lit(None).cast("string").alias("digest"),
        F.create_map(F.lit("Date"), again.cast("string"), F.lit("Cache-Control"), F.lit("max-age=600"), F.lit("Content-Length"), F.lit("0")).alias("headers"),
    )
    records = base.select("url_key", "etag", F.explode(F.array(response, revisit)).alias("record"))
    return records.select("url_key", "etag", F.lit(None).cast("string").alias("last_modified"), "record.*")


#: Records between a page and the request for it again.
REVISIT_AFTER = 1000


def op10_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resolve(crawl_records(read_table(spark, sf_dir, "pages").select("page_id", "url", "html")))
    pairs = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))), "\n")
    return found.select("record_id", "url_key", "ts", "latest", "refers_to", "status", pairs.alias("headers"))
