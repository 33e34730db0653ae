"""What blocking and features compare: tokens, variants, domains and years of a profile, computed once per profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.functions.text import authority, norm_text

#: Sources whose own url counts as a domain of the person.
OWN_URL_SOURCES = ("personal_site", "huggingface")


def _strings(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.filter(c, lambda x: x.isNotNull()), F.array().cast("array<string>"))


def _tokens(texts: Column, longer_than: int) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.flatten(F.transform(texts, lambda t: F.split(norm_text(t), " "))), lambda t: F.length(t) > longer_than)))


def org_names() -> Column:
    return _strings(F.transform("organizations", lambda o: o["name"]))


def name_tokens() -> Column:
    """Tokens of more than one character of the name and its aliases."""
    return _tokens(F.concat(F.array(F.coalesce("display_name", F.lit(""))), _strings("aliases")), 1)


def name_variants() -> Column:
    """The name, its aliases, 'first l' and 'f last'."""
    base = norm_text(F.coalesce("display_name", F.lit("")))
    parts = F.split(base, " ")
    first, last = F.get(parts, F.lit(0)), F.element_at(parts, -1)
    short = F.array(F.concat_ws(" ", first, F.substring(last, 1, 1)), F.concat_ws(" ", F.substring(first, 1, 1), last))
    both = F.concat(F.array(base), F.transform(_strings("aliases"), norm_text), F.when(F.size(parts) >= 2, short).otherwise(F.array().cast("array<string>")))
    return F.array_sort(F.array_distinct(F.filter(both, lambda v: v != "")))


def domains() -> Column:
    """Hosts of the links, and of the profile's url for the sources where that is the person's."""
    own = F.when(F.col("source_type").isin(*OWN_URL_SOURCES), F.array("url")).otherwise(F.array().cast("array<string>"))
    hosts = F.transform(_strings(F.concat(_strings("outbound_links"), own)), lambda u: F.replace(authority(u), F.lit("www."), F.lit("")))
    return F.array_sort(F.array_distinct(F.filter(hosts, lambda h: h != "")))


def org_tokens(longer_than: int = 2) -> Column:
    return _tokens(org_names(), longer_than)


def topic_tokens(longer_than: int = 2) -> Column:
    return _tokens(F.concat(F.array(F.coalesce("headline", F.lit(""))), _strings("topics")), longer_than)


def location_tokens() -> Column:
    return _tokens(_strings("locations"), 0)


def years() -> Column:
    """First four characters of the timestamps that are years, and the years of the organisations."""
    stamps = F.transform(_strings("timestamps"), lambda t: F.substring(F.trim(t), 1, 4).try_cast("int"))
    orgs = F.flatten(F.transform(F.coalesce("organizations", F.array().cast("array<struct<name:string,role:string,start_year:int,end_year:int>>")), lambda o: F.array(o["start_year"], o["end_year"])))
    return F.array_sort(F.array_distinct(F.filter(F.concat(stamps, orgs), lambda y: y.isNotNull() & (y != 0))))


def normalized_text() -> Column:
    """Eleven groups of fields and the domains of the links as one lower-case line, in a fixed order."""
    roles = _strings(F.transform("organizations", lambda o: o["role"]))
    edu = _strings(F.transform("education", lambda e: e["institution"])), _strings(F.transform("education", lambda e: e["degree"]))
    hosts = F.transform(_strings("outbound_links"), lambda u: F.replace(authority(u), F.lit("www."), F.lit("")))
    fields = [F.array(F.coalesce("display_name", F.lit(""))), _strings("aliases"), F.array(F.coalesce("headline", F.lit(""))), F.array(F.coalesce("bio_text", F.lit(""))), org_names(), roles, *edu, _strings("locations"), _strings("topics"), _strings("timestamps"), hosts]
    return norm_text(F.array_join(F.concat(*fields), " "))


def profile_keys(profiles: DataFrame, text: bool = False) -> DataFrame:
    """The key columns of every profile, with :func:`normalized_text` (``text``) if asked; later joins carry these instead of whole rows."""
    return profiles.select(
        "profile_id", "canonical_person_id", "source_type", "display_name", "aliases", "headline", "bio_text",
        name_variants().alias("variants"), name_tokens().alias("name_tokens"), domains().alias("domains"), org_tokens().alias("org_tokens"), topic_tokens().alias("topic_tokens"),
        org_tokens(0).alias("org_set"), topic_tokens(0).alias("topic_set"), location_tokens().alias("location_set"), years().alias("years"),
        *[normalized_text().alias("text")] * text,
    )


