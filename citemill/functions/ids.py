"""Paper identifiers of several catalogs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Public forms of arXiv numbers, in URLs and bare, new and old.
ARXIV_URL = r"arxiv\.org/(?:abs|pdf|html)/(\d+\.\d+)"
ARXIV_NEW, ARXIV_OLD = r"^\d{4}\.\d{4,5}(v\d+)?$", r"^[a-z-]+/\d+$"


def normalize_id(raw: Column) -> Column:
    """arXiv URLs and bare arXiv numbers, old and new, get the prefix ARXIV:; others stay, trimmed."""
    bare = F.trim(raw)
    linked = F.regexp_extract(bare, ARXIV_URL, 1)
    number = F.rlike(bare, F.lit(ARXIV_NEW)) | F.rlike(bare, F.lit(ARXIV_OLD))
    return F.when(linked != "", F.concat(F.lit("ARXIV:"), linked)).when(number, F.concat(F.lit("ARXIV:"), bare)).otherwise(bare)


def _given(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


def doi_of(external: Column, doi: Column) -> Column:
    return F.coalesce(_given(external["DOI"]), F.replace(_given(doi), F.lit("https://doi.org/"), F.lit("")))


def arxiv_of(external: Column, listed: Column) -> Column:
    return F.coalesce(_given(external["ArXiv"]), F.get(listed, 0))


def openalex_of(external: Column, url: Column) -> Column:
    last = F.element_at(F.split(F.rtrim(url, F.lit("/")), "/"), -1)
    return F.when(url.startswith("https://openalex.org/"), F.when(~last.isin("", "openalex.org"), last)).otherwise(_given(external["OpenAlex"]))


def author_id(given: Column, paper_id: Column, position: Column, name: Column) -> Column:
    """The id given, or else one that follows from paper, position and name."""
    return F.coalesce(_given(given), F.sha2(F.concat_ws("|", paper_id, position.cast("string"), F.coalesce(name, F.lit(""))), 256))


def tree_id(paper_id: Column, made: Column) -> Column:
    return F.concat(F.regexp_replace(paper_id, "[:/]", "_"), F.lit("_"), F.date_format(made, "yyyyMMddHHmmss"))


def pdf_name(paper_id: Column, published: Column) -> Column:
    """Year and month of an ISO date before the id; unknown parts are 0."""
    part = lambda n: F.coalesce(F.get(F.split(published, "-"), n), F.lit("0"))
    return F.concat(part(0), F.lit("_"), part(1), F.lit("_"), F.regexp_replace(paper_id, "[:/]", "_"), F.lit(".pdf"))


def is_pdf(content: Column) -> Column:
    return (F.octet_length(content) >= 1024) & (F.substring(content, 1, 5) == F.lit(b"%PDF-"))


def pdf_source(arxiv_id: Column, open_access: Column, by_doi: Column) -> Column:
    """Struct url and source of the first place that has a PDF; null without any."""
    url = F.when(arxiv_id.isNotNull(), F.concat(F.lit("https://arxiv.org/pdf/"), arxiv_id, F.lit(".pdf")))
    found = F.coalesce(url, open_access, by_doi)
    label = F.when(url.isNotNull(), "arxiv").when(open_access.isNotNull(), "semantic_scholar").when(by_doi.isNotNull(), "unpaywall")
    return F.when(found.isNotNull(), F.struct(found.alias("url"), label.alias("source")))


def text_source(*tiers: tuple[str, Column]) -> Column:
    """Struct text and source of the first tier that has text."""
    label = F.coalesce(*[F.when(_given(text).isNotNull(), F.lit(name)) for name, text in tiers])
    return F.struct(F.coalesce(*[_given(text) for _, text in tiers]).alias("text"), label.alias("source"))


def primary_field(fields: Column, sourced: Column) -> Column:
    """The first field, or else the first sourced field (struct category, source) from an external source, or else the
    first sourced field."""
    external = F.filter(sourced, lambda s: s["source"] == "external")
    return F.coalesce(F.get(fields, 0), F.get(external, 0)["category"], F.get(sourced, 0)["category"])
