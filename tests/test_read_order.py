"""Positions follow files by name and lines, though Spark deals the largest files first."""

from __future__ import annotations

from citemill import registry
from citemill.sources import readers


def test_positions_follow_files(spark, tmp_path):
    at = 0
    for name, lines in (("a", 3), ("b", 4000), ("c", 40)):
        (tmp_path / f"{name}.json").write_text("".join(f'{{"n": {i}}}\n' for i in range(at, at + lines)))
        at += lines
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")  # blocks of one file, and files in one task
    try:
        found = readers.with_position(readers.json_lines(spark, str(tmp_path), "n long")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(found) == at and all(r.n == r.position for r in found)


def test_positions_in_a_table_of_many_files(spark, tmp_path):
    """The order is that of page_id, whatever file a page is in."""
    for part, (low, high, step) in enumerate(((7, 3000, 3), (0, 3, 1), (5000, 5002, 1), (3000, 4999, 2))):
        spark.range(low, high, step, 1).withColumnRenamed("id", "page_id").write.mode("append").parquet(str(tmp_path / "pages.parquet"))
    found = sorted((r.page_id, r.sample) for r in registry.queries()["s12_w08_positions"](spark, str(tmp_path)).collect())
    assert [n for _, n in found] == list(range(len(found))) and len(found) == 2003
