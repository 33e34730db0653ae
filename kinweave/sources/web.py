"""Pages and search results from outside. Backends are injected: there is no network in the engine itself."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Parts of a url that tell the source, in the order in which they are tried.
HINTS = (
    ("github.com", "github"), ("huggingface.co", "huggingface"), ("linkedin.com", "company_profile"), ("twitter.com", "personal_site"), ("x.com", "personal_site"),
    ("medium.com", "personal_site"), ("substack.com", "personal_site"), ("wordpress.com", "personal_site"), ("youtube.com", "podcast_guest"), ("podcasts.apple.com", "podcast_guest"),
    ("spotify.com", "podcast_guest"), ("speakerdeck.com", "conference_bio"), ("slideshare.net", "conference_bio"), ("scholar.google.com", "conference_bio"), ("arxiv.org", "conference_bio"),
)


def guess_source(url: Column) -> Column:
    """The source of the first hint that the url contains anywhere; personal_site without one, also for null."""
    low, out = F.lower(url), F.lit("personal_site")
    for part, source in reversed(HINTS):
        out = F.when(F.contains(low, F.lit(part)), source).otherwise(out)
    return out


def fetch(urls: DataFrame, get: Callable[[str], str]) -> DataFrame:
    """(``url``, ``html``) by an injected getter; a failure gives an empty page."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for u in b["url"]:
                try:
                    out.append(get(u) or "")
                except Exception:
                    out.append("")
            yield pd.DataFrame({"url": b["url"], "html": out})

    return urls.select("url").mapInPandas(run, "url string, html string")


def pages_from_urls(urls: DataFrame, get: Callable[[str], str]) -> DataFrame:
    """Raw pages of fetched urls: raw text is the first 5000 characters; empty pages drop out."""
    f = fetch(urls, get).filter("html <> ''")
    return f.select(F.concat(F.lit("live-"), F.substring(F.sha2("url", 256), 1, 12)).alias("page_id"), guess_source(F.col("url")).alias("source_type"), "url", F.lit(None).cast("string").alias("canonical_person_id"), F.lit(None).cast("string").alias("display_name_hint"), F.current_timestamp().alias("fetched_at"), F.lit(None).cast("string").alias("title"), "html", F.substring("html", 1, 5000).alias("raw_text"))


def search(spark: SparkSession, name: str, find: Callable[[str, int], list[dict]], most: int = 8) -> DataFrame:
    """Hits (``rank``, ``title``, ``url``, ``snippet``, ``source_type``) of an injected search; a failure gives none."""
    try:
        got = find(f"{name} profile", most)
    except Exception:
        got = []
    rows = [(i, str(h.get("title") or ""), str(h.get("href") or h.get("url") or ""), str(h.get("body") or h.get("snippet") or "")) for i, h in enumerate(got[:most])]
    df = spark.createDataFrame(rows, "rank int, title string, url string, snippet string")
    return df.filter("url <> ''").withColumn("source_type", guess_source(F.col("url")))


def hits_to_rows(hits: DataFrame, by: str = "rank") -> DataFrame:
    """The first hit of each url with title and snippet cut to 120 and 500 characters."""
    k = F.row_number().over(Window.partitionBy("url").orderBy(by))
    return hits.withColumn("k", k).filter("k = 1").select("url", F.substring("title", 1, 120).alias("title"), F.substring("snippet", 1, 500).alias("snippet"), "source_type")
