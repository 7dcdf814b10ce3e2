"""Quality checks of the tables as rows (category, entity, name, passed), their score and its gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citemill.functions.metrics import zero
from citemill.functions.text import venue_type
from citemill.operators.validate import blank

MIN_SCORE = 0.85
ERAS = ["pre_2000", "2000_2010", "2010_2015", "2015_2020", "2020_plus"]
RANGES = ["low_0_100", "medium_100_1k", "high_1k_10k", "very_high_10k_plus"]
VENUES = ["top_conference", "journal", "arxiv", "other"]


class QualityTooLow(ValueError):
    """The score of the checks is below the limit."""


def era(year: Column) -> Column:
    """Null for a missing year (or 0)."""
    return F.when(year.isNull() | (year == 0), None).when(year < 2000, ERAS[0]).when(year < 2010, ERAS[1]).when(year < 2015, ERAS[2]).when(year < 2020, ERAS[3]).otherwise(ERAS[4])


def citation_range(count: Column) -> Column:
    n = zero(count)
    return F.when(n < 100, RANGES[0]).when(n < 1000, RANGES[1]).when(n < 10000, RANGES[2]).otherwise(RANGES[3])


def _rows(rows: DataFrame, category: str, entity: str, name: str, passed: Column) -> DataFrame:
    return rows.select(F.lit(category).alias("category"), F.lit(entity).alias("entity"), F.lit(name).alias("name"), passed.alias("passed"))


def schema_checks(papers: DataFrame, authors: DataFrame, citations: DataFrame) -> DataFrame:
    """A paper fails at its first missing field; when that is the year it gives no verdict at all."""
    fields = ["paper_id", "title", "year", "citation_count", "influential_count", "reference_count"]
    first = F.coalesce(*[F.when(F.col(f).isNull(), F.lit(f)) for f in fields])
    verdict = _rows(papers.withColumn("first", first).filter("first is null or first <> 'year'"), "schema", "paper", "required fields", F.col("first").isNull())
    of_authors = _rows(authors, "schema", "author", "required fields", ~(blank(F.col("paper_id")) | blank(F.col("author_name"))))
    of_edges = _rows(citations, "schema", "citation", "required fields", ~(blank(F.col("from_id")) | blank(F.col("to_id"))))
    return verdict.unionByName(of_authors).unionByName(of_edges)


def statistics_checks(papers: DataFrame, citations: DataFrame) -> DataFrame:
    count = _rows(papers, "statistics", "paper", "count", zero(F.col("citation_count")) >= 0)
    year = _rows(papers, "statistics", "paper", "year", F.coalesce((F.col("year") == 0) | F.col("year").between(1900, 2030), F.lit(True)))
    n = F.row_number().over(Window.partitionBy("from_id", "to_id").orderBy("pos"))
    return count.unionByName(year).unionByName(_rows(citations.withColumn("n", n), "statistics", "citation", "unique", F.col("n") == 1))


def integrity_checks(papers: DataFrame, authors: DataFrame, citations: DataFrame) -> DataFrame:
    ids = papers.select(F.col("paper_id").alias("known")).distinct()
    of_authors = authors.join(ids, F.col("paper_id") == F.col("known"), "left")
    ends = citations.join(ids.withColumnRenamed("known", "known_from"), F.col("from_id") == F.col("known_from"), "left")
    ends = ends.join(ids.withColumnRenamed("known", "known_to"), F.col("to_id") == F.col("known_to"), "left")
    return _rows(of_authors, "integrity", "author", "paper", F.col("known").isNotNull()).unionByName(_rows(ends, "integrity", "citation", "papers", F.col("known_from").isNotNull() & F.col("known_to").isNotNull()))


def slices(papers: DataFrame) -> DataFrame:
    """dimension, slice and share of all papers, for the eras, citation ranges and venue types; one pass. Empty slices
    have share 0; papers without a year are in no era."""
    names = [("temporal", e) for e in ERAS] + [("citation", r) for r in RANGES] + [("venue", v) for v in VENUES]
    marked = papers.select(era(F.col("year")).alias("temporal"), citation_range(F.col("citation_count")).alias("citation"), venue_type(F.col("venue")).alias("venue"))
    counts = marked.agg(F.count("*").alias("total"), *[F.count_if(F.col(d) == s).alias(f"{d}_{n}") for n, (d, s) in enumerate(names)])
    share = lambda n, d: F.when(F.col("total") > 0, F.col(f"{d}_{n}") / F.col("total")).otherwise(0.0)
    each = F.array(*[F.struct(F.lit(d).alias("dimension"), F.lit(s).alias("slice"), share(n, d).alias("share")) for n, (d, s) in enumerate(names)])
    return counts.select(F.explode(each).alias("s")).select("s.*")


def bias_checks(papers: DataFrame) -> DataFrame:
    """Each era neither above half nor (2010 to 2019) absent; not over 70 % highly cited; some with few citations; more
    than one venue type. Each venue type above 60 % adds a failure."""
    s = slices(papers)
    share, name = F.col("share"), F.col("slice")
    late = (share == 0) & name.isin("2010_2015", "2015_2020")
    eras = _rows(s.filter("dimension = 'temporal'"), "bias", "temporal", "era", ~((share > 0.5) | late))
    of = s.agg(
        F.sum(F.when(name.isin(RANGES[2], RANGES[3]), share)).alias("high"),
        F.sum(F.when(name == RANGES[0], share)).alias("low"),
        F.count_if((F.col("dimension") == "venue") & (share > 0)).alias("venues"),
    )
    rest = _rows(of, "bias", "citation", "highly cited", F.col("high") <= 0.7).unionByName(_rows(of, "bias", "citation", "low counts", F.col("low") > 0)).unionByName(_rows(of, "bias", "venue", "diversity", F.col("venues") >= 2))
    over = _rows(s.filter("dimension = 'venue' and share > 0.6"), "bias", "venue", "concentration", F.lit(False))
    return eras.unionByName(rest).unionByName(over)


def all_checks(papers: DataFrame, authors: DataFrame, citations: DataFrame) -> DataFrame:
    return schema_checks(papers, authors, citations).unionByName(statistics_checks(papers, citations)).unionByName(integrity_checks(papers, authors, citations)).unionByName(bias_checks(papers))


def quality_report(checks: DataFrame) -> DataFrame:
    total, passed = F.count("*"), F.count_if("passed")
    return checks.agg(total.alias("total_checks"), passed.alias("passed_checks"), (total - passed).alias("failed_checks"), F.coalesce(F.try_divide(passed, total), F.lit(0.0)).alias("quality_score"))


def check_quality(report: DataFrame, limit: float = MIN_SCORE) -> float:
    score = report.first()["quality_score"]
    if score < limit:
        raise QualityTooLow(f"{score:.1%} of the checks passed; {limit:.0%} are needed")
    return score
