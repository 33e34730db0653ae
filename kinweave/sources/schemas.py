"""Row types and the checks that rows must pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The kinds of source, decision and confidence band.
SOURCE_TYPES = ("github", "personal_site", "conference_bio", "company_profile", "podcast_guest", "huggingface")
DECISIONS = ("match", "non_match", "abstain")
BANDS = ("high", "medium", "low", "uncertain")
FIRST_YEAR, LAST_YEAR = 1950, 2100

PROFILE = """profile_id string, canonical_person_id string, source_type string, url string, display_name string, aliases array<string>,
headline string, bio_text string, organizations array<struct<name:string,role:string,start_year:int,end_year:int>>,
education array<struct<institution:string,degree:string,graduation_year:int>>, locations array<string>, outbound_links array<string>,
topics array<string>, timestamps array<string>, raw_text string,
supporting_spans array<struct<field_name:string,snippet:string,start_char:int,end_char:int>>, metadata map<string,string>"""
RAW_PAGE = """page_id string, source_type string, url string, canonical_person_id string, display_name_hint string, fetched_at timestamp,
title string, html string, raw_text string"""


def clean_lists(profiles: DataFrame) -> DataFrame:
    """Trim list entries and drop blank ones; collapse white space in the display name."""
    out = profiles
    for c in ("aliases", "locations", "topics", "timestamps"):
        out = out.withColumn(c, F.filter(F.transform(c, lambda x: F.trim(x)), lambda x: x != ""))
    return out.withColumn("display_name", F.trim(F.regexp_replace("display_name", r"\s+", " ")))


def violations() -> Column:
    """Names of the rules that a profile row breaks, in a fixed order; an empty array for a valid row."""
    def year(y: Column) -> Column:
        return y.isNotNull() & ~y.between(FIRST_YEAR, LAST_YEAR)

    no = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    org_years = F.exists("organizations", lambda o: year(o["start_year"]) | year(o["end_year"]))
    org_order = F.exists("organizations", lambda o: (F.coalesce(o["start_year"], F.lit(0)) != 0) & (F.coalesce(o["end_year"], F.lit(0)) != 0) & (o["end_year"] < o["start_year"]))
    edu_years = F.exists("education", lambda e: year(e["graduation_year"]))
    span_order = F.exists("supporting_spans", lambda s: s["end_char"] < s["start_char"])
    rules = {
        "profile_id": ~F.coalesce(F.col("profile_id").rlike(r"^[a-z0-9_\-]+$"), F.lit(False)),
        "canonical_person_id": F.col("canonical_person_id").isNotNull() & ~F.col("canonical_person_id").rlike(r"^[a-z0-9_\-]+$"),
        "source_type": ~F.coalesce(F.col("source_type").isin(*SOURCE_TYPES), F.lit(False)),
        "url": ~F.coalesce(F.col("url").rlike(r"^https?://[^/\s]+"), F.lit(False)),
        "display_name": no("display_name"), "bio_text": no("bio_text"), "raw_text": no("raw_text"),
        "organization_years": org_years, "organization_order": org_order, "education_years": edu_years,
        "span_order": span_order, "supporting_spans": F.coalesce(F.size("supporting_spans"), F.lit(0)) < 1,
    }
    return F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), name) for name, bad in rules.items()]))


def validated(profiles: DataFrame, strict: bool = False) -> DataFrame:
    """Cleaned rows with a ``violations`` column; ``strict`` raises on the first invalid row instead of reporting it.

    Null arrays count as empty, so such a row only breaks the span rule.
    """
    rows = clean_lists(profiles).withColumn("violations", violations())
    if strict:
        rows = rows.withColumn("violations", F.when(F.size("violations") > 0, F.raise_error(F.concat(F.lit("invalid row "), F.coalesce("profile_id", F.lit("?")))).cast("array<string>")).otherwise(F.col("violations")))
    return rows


def latest(rows: DataFrame, key: str = "profile_id", at: str = "ingested_at") -> DataFrame:
    """One row per key, the last delivered; equal times keep any of the (then equal) rows."""
    cols = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*cols), F.col(at)).alias("r")).select(key, "r.*")
