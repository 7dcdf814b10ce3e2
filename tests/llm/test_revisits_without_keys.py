"""Revisits and responses without URL or time."""

from pyspark.sql import functions as F

from citemill.llm.warc_revisits import STRETCHES, _stretches, resolve

SCHEMA = "record_id long, url_key string, ts double, kind string, etag string, last_modified string, digest string, headers map<string,string>"


def test_records_without_key_meet_nothing(spark):
    rows = [
        (1, None, 1.0, "response", "a", None, None, {"Date": "1"}),
        (2, None, 2.0, "revisit", "a", None, None, None),
        (3, "u", None, "response", "a", None, None, {"Date": "1"}),
        (4, "u", None, "revisit", "a", None, None, None),
        (5, "u", 5.0, "revisit", "a", None, None, None),
        (6, "u", 6.0, "response", "a", None, None, {"Date": "6"}),
        (7, "u", 7.0, "revisit", "a", None, None, {"Date": "7"}),
        (8, None, None, "revisit", None, None, None, None),
    ]
    found = {r.record_id: (r.status, r.refers_to) for r in resolve(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found == {2: ("no-response", None), 4: ("no-response", None), 5: ("no-response", None), 7: ("resolved", 6), 8: ("no-response", None)}


def test_only_records_without_key(spark):
    rows = spark.createDataFrame([(1, None, None, "revisit", "a", None, None, None)], SCHEMA)
    assert resolve(rows).select("status").first()[0] == "no-response"
    assert resolve(rows.filter(F.lit(False))).isEmpty()


def test_wrong_times_leave_no_crowded_stretch(spark):
    """Records of the years 0 and 9999 don't put a URL's other captures into a few windows, and all are resolved as before."""
    n = 40_960
    rows = spark.range(n).select(
        F.col("id").alias("record_id"), F.lit("u").alias("url_key"), F.when(F.col("id") == 0, -6.2e10).when(F.col("id") == 1, 2.5e11).when(F.col("id") == 2, float("inf")).otherwise(1.7e9 + F.col("id") * 10).alias("ts"),
        F.when(F.col("id") % 9 == 4, "response").otherwise("revisit").alias("kind"), F.lit("e").alias("etag"), F.lit(None).cast("string").alias("last_modified"), F.lit(None).cast("string").alias("digest"),
        F.create_map(F.lit("Date"), F.col("id").cast("string")).alias("headers"),
    )
    sizes = [r["count"] for r in _stretches(rows).groupBy("stretch").count().collect()]
    assert sum(sizes) == n and max(sizes) <= 2 * n / STRETCHES
    found = {r.record_id: r.refers_to for r in resolve(rows).collect()}
    latest = None
    for i in range(3, n):
        if i % 9 == 4:
            latest = i
        else:
            assert found[i] == latest
    assert found[0] is None and found[1] == found[2] == latest
