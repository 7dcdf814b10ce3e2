"""Cleaning and classification of text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as white space in Unicode text; Java's \s is ASCII only.
SPACES = "[\\t-\\r\\x1c-\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+"
#: Fixed value: control characters that are deleted.
CONTROLS = "[\\x00-\\x1f\\x7f-\\x9f]"
#: Abbreviations in venue names, in the order they are replaced.
VENUE_WORDS = [("conf", "Conference"), ("proc", "Proceedings"), ("int'l", "International"), ("intl", "International"), ("symp", "Symposium"), ("trans", "Transactions")]
#: Parts of titles that are off topic.
OFF_TOPIC = [
    "medical", "clinical", "disease", "patient", "diagnosis", "ecg", "mri", "ct scan", "imaging", "radiology", "tooth",
    "dental", "retinal", "octa", "tumor", "cancer", "segmentation", "lung", "liver", "brain", "heart",
]
#: Conference names as they are sought in upper-case venues; mixed-case names therefore never match.
TOP_VENUES = ["NeurIPS", "NIPS", "ICML", "ICLR", "ACL", "EMNLP", "CVPR", "ICCV", "ECCV", "AAAI", "IJCAI"]


def clean_text(text: Column) -> Column:
    """One space for each run of white space, none at the ends, no control characters; null becomes empty."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " "), "^ | $", ""), CONTROLS, "")


def clean_venue(venue: Column) -> Column:
    """Abbreviations written out, then cleaned."""
    for short, full in VENUE_WORDS:
        venue = F.regexp_replace(venue, rf"(?i)\b{short}\b", full)
    return clean_text(venue)


def clean_authors(authors: Column) -> Column:
    return F.transform(authors, lambda a: a.withField("name", clean_text(a["name"])))


def off_topic(title: Column) -> Column:
    return F.coalesce(F.rlike(F.lower(title), F.lit("|".join(OFF_TOPIC))), F.lit(False))


def venue_type(venue: Column) -> Column:
    upper = F.upper(F.coalesce(venue, F.lit("")))
    top = F.rlike(upper, F.lit("|".join(TOP_VENUES)))
    return (
        F.when(top, "top_conference").when(upper.contains("ARXIV") | (upper == ""), "arxiv").when(upper.contains("JOURNAL") | upper.contains("TRANSACTIONS"), "journal").otherwise("other")
    )


def ellipsis(text: Column, limit: int = 60) -> Column:
    """At most limit characters, the last three of which are dots where something is cut."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - 3), F.lit("..."))).otherwise(text)


def header(name: Column) -> Column:
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))


def safe_file_name(name: Column) -> Column:
    return F.regexp_replace(name, "[^A-Za-z0-9._-]+", "_")


def domain_of(text: Column) -> Column:
    low, found = F.lower(text), F.lit("Other")
    for domain in ("mathematics", "physics", "computer science"):
        found = F.when(low.contains(domain), domain.title()).otherwise(found)
    return found


#: The tiers of a citation count that a text states, by the count at which the next begins.
STATED_TIERS = [("low", 200), ("medium", 1000), ("high", 10000), ("landmark", None)]


def popularity_in_text(text: Column) -> Column:
    """The tier of the citation count that a text states in the form name, colon or equals sign, number: one named
    citationCount rather than one named citation or citations."""
    stated = F.regexp_extract_all(F.lower(text), F.lit(r"citation(count|s|)[\"']?\s*[:=]\s*([0-9]+)"), F.lit(0))
    number = lambda found: F.regexp_extract(found, "[0-9]+$", 0).cast("decimal(38,0)")
    by_name = F.concat(F.filter(stated, lambda x: x.startswith("citationcount")), stated)
    count, tier = number(F.get(by_name, 0)), F.lit(STATED_TIERS[-1][0])
    for name, end in reversed(STATED_TIERS[:-1]):
        tier = F.when(count < end, name).otherwise(tier)
    return F.when(count.isNull(), "unknown").otherwise(tier)


def candidate_ids(prompt: Column, pattern: str = r"paper_?id[\"']?\s*[:=]\s*[\"']?([A-Za-z0-9]+)") -> Column:
    return F.array_distinct(F.regexp_extract_all(prompt, F.lit("(?i)" + pattern), F.lit(1)))


def source_type(availability: Column) -> Column:
    low = F.lower(F.coalesce(availability, F.lit("")))
    return F.when(low.contains("full"), "full_text").when(low.contains("abstract"), "abstract").otherwise("unknown")


def sentiment(rating: Column) -> Column:
    return F.when(rating.isNull(), "unknown").when(rating > 0, "positive").otherwise("negative")


def log_line(line: Column) -> Column:
    """Struct ts, source, level, message of "[ts] {source} LEVEL - message"; a line of another form is its own message."""
    pattern = r"(?s)^\[([^\]]*)\] \{([^}]*)\} (\w+) - (.*)$"
    part = lambda n: F.nullif(F.regexp_extract(line, pattern, n), F.lit(""))
    return F.struct(part(1).alias("ts"), part(2).alias("source"), part(3).alias("level"), F.coalesce(part(4), line).alias("message"))


def parsed_time(value: Column, now: Column) -> Column:
    """A time in text; what is none, or missing, is now."""
    return F.coalesce(F.try_to_timestamp(value), now)


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / 4).cast("int")


def model_cost(tokens_in: Column, tokens_out: Column, cut: int = 200_000, low: tuple[float, float] = (1.25, 10.0), high: tuple[float, float] = (2.5, 15.0)) -> Column:
    """Price of a call by millions of tokens, dearer when the input is above the cut."""
    price = lambda n: F.when(tokens_in > cut, high[n]).otherwise(low[n])
    return (tokens_in * price(0) + tokens_out * price(1)) / 1e6


def prompt(title: Column, text: Column, candidates: Column, contexts: int = 5) -> Column:
    """The paper, then its numbered candidates with a few contexts each."""
    one = F.transform(candidates, lambda c, i: F.concat_ws("\n", F.concat((i + 1).cast("string"), F.lit(". "), c["title"]), F.array_join(F.transform(F.slice(c["contexts"], 1, contexts), lambda x: F.concat(F.lit("   - "), x)), "\n")))
    return F.concat_ws("\n\n", F.concat(F.lit("Paper: "), title), text, F.array_join(one, "\n"))


def paper_document(title: Column, abstract: Column, sections: Column, limit: int = 150_000) -> Column:
    body = F.array_join(F.transform(sections, lambda s: F.concat(F.lit("## "), s["name"], F.lit("\n"), s["text"])), "\n\n")
    return F.substring(F.concat_ws("\n\n", F.concat(F.lit("# "), title), abstract, body), 1, limit)
