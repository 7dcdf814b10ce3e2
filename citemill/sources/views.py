"""Citation tables as views of the star-schema test tables.

A view is one SELECT that Spark and DuckDB read alike, so a query and its oracle share the text. {parts} and
{suppliers} stand for the numbers of rows of part and supplier. Lines play the role that their flag gives them: R references, A citations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_EDGE = """
    SELECT CAST(l_orderkey * 10 + l_linenumber AS bigint) AS pos, CAST(l_orderkey % {parts} AS varchar(20)) AS from_id,
           CAST(l_partkey % {parts} AS varchar(20)) AS to_id, l_discount > 0.05 AS is_influential,
           l_tax > 0.04 AS is_methodology, l_discount <= 0.03 AS is_background, 'DIRECTION' AS direction
    FROM lineitem WHERE l_returnflag = 'FLAG'
"""

#: Name -> (tables, SELECT).
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "papers": (
        ("part",),
        """
        SELECT CAST(p_partkey % {parts} AS varchar(20)) AS paper_id, p_partkey AS pos, p_name AS title,
               CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_brand || ' ' || p_type END AS venue,
               CASE WHEN p_partkey % 23 = 0 THEN NULL ELSE CAST(1980 + p_partkey % 46 AS int) END AS year,
               CAST(floor(p_retailprice * p_size) AS bigint) AS citation_count,
               CAST(p_size AS bigint) AS influential_count, CAST(p_partkey % 60 AS bigint) AS reference_count,
               CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_type END AS abstract
        FROM part
        """,
    ),
    "refs": (("lineitem", "part"), _EDGE.replace("DIRECTION", "backward").replace("FLAG", "R")),
    "cits": (("lineitem", "part"), _EDGE.replace("DIRECTION", "forward").replace("FLAG", "A")),
    "nodes": (("supplier",), "SELECT CAST(s_suppkey % {suppliers} AS varchar(20)) AS id FROM supplier"),
    "edges": (
        ("lineitem", "supplier"),
        """
        SELECT CAST(l_orderkey * 10 + l_linenumber AS bigint) AS pos, CAST(l_partkey % {suppliers} AS varchar(20)) AS src,
               CAST(l_suppkey % {suppliers} AS varchar(20)) AS dst
        FROM lineitem WHERE l_returnflag = 'R'
        """,
    ),
    "authors": (
        ("lineitem", "supplier", "part"),
        """
        SELECT DISTINCT CAST(l_partkey % {parts} AS varchar(20)) AS paper_id, CAST(s_suppkey AS varchar(20)) AS author_id, s_name AS author_name
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
        """,
    ),
    "feedback": (
        ("events", "part"),
        """
        SELECT CAST(event_id AS varchar(20)) AS feedback_id, CAST(user_id % {parts} AS varchar(20)) AS paper_id, event_type AS view_type,
               CASE WHEN event_id % 17 = 0 THEN NULL WHEN value > 50 THEN 1 ELSE -1 END AS rating, ts AS created_at
        FROM events
        """,
    ),
    "logs": (("events",), "SELECT ts, upper(event_type) AS level, 'user_' || CAST(user_id % 7 AS varchar(20)) AS logger, value FROM events"),
    "examples": (
        ("orders", "customer"),
        """
        SELECT o_orderkey AS sample, CAST(o_custkey AS varchar(20)) AS paper_a, CAST(o_custkey * 7 % 400 AS varchar(20)) AS paper_b,
               o_orderpriority AS field, o_orderstatus AS tier, CAST(year(o_orderdate) AS int) AS year, CAST(floor(o_totalprice) AS bigint) AS citation_count
        FROM orders
        """,
    ),
}


def count_rows(spark: SparkSession, sf_dir: str, table: str) -> int:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").count()


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view as a DataFrame; edges get the array of intents that operators take."""
    tables, select = VIEWS[name]
    sizes = {"parts": "part", "suppliers": "supplier"}
    text = select.format(**{k: count_rows(spark, sf_dir, t) if f"{{{k}}}" in select else 0 for k, t in sizes.items()})
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables if t not in ("part", "supplier") or f"FROM {t}" in text or f"JOIN {t}" in text}
    for t in frames:
        text = text.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t}", f"JOIN {{{t}}}")
    found = spark.sql(text, **frames)
    if "is_methodology" in found.columns:
        found = found.withColumn("intents", F.array_compact(F.array(F.when(F.col("is_methodology"), "methodology"), F.when(F.col("is_background"), "background"))))
    return found


def with_views(*names: str, sql: str, recursive: bool = False) -> str:
    """sql for DuckDB, with the named views in front."""
    sizes = {"parts": "(SELECT count(*) FROM part)", "suppliers": "(SELECT count(*) FROM supplier)"}
    parts = ", ".join(f"{n} AS ({VIEWS[n][1].format(**sizes)})" for n in names)
    rest = sql.strip()
    if rest.upper().startswith("WITH RECURSIVE "):
        recursive, rest = True, ", " + rest[15:]
    elif rest.upper().startswith("WITH "):
        rest = ", " + rest[5:]
    return f"WITH {'RECURSIVE ' if recursive else ''}{parts} {rest}"
