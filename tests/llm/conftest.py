from __future__ import annotations

import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.sql.warehouse.dir", str(folder / "warehouse")).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


#: Null texts and ids, empty and long texts, ties, repeated rows, a column with a name that operators use.
ODD_ROWS = [
    (1, "alpha beta gamma delta.\nsecond line here", "s1", 1),
    (2, "alpha beta gamma delta.\nsecond line here", "s1", 1),
    (2, "alpha beta gamma delta.\nsecond line here", "s1", 1),
    (3, None, None, 2),
    (4, "", "s2", None),
    (None, "no id but words", "s2", 4),
    (None, None, None, None),
    (5, " \t\n ", "s3", 5),
    (6, "é𝄞 token=abcdefgh secret: 'xy' " * 3000, "s3", 6),
    (7, "x", "", 7),
]
ODD_SCHEMA = "doc_id long, text string, source string, fp int"


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD_ROWS, ODD_SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], ODD_SCHEMA)


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    """The rows of documents by doc_id."""
    return {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
