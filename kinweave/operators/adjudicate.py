"""Prompts for a judge of borderline pairs, its injectable backend, and the reading of its answers. Off unless a backend is given."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from kinweave.operators.features import FULL


def profile_summary(side: str) -> Column:
    """Seven lines about a profile struct: at most four organisations, three places, six topics and 300 characters of the bio."""
    def some(values: Column, n: int) -> Column:
        return F.when(F.coalesce(F.size(values), F.lit(0)) > 0, F.array_join(F.slice(values, 1, n), ", ")).otherwise("none")

    c = lambda f: F.col(f"{side}.{f}")
    return F.concat(
        F.lit("Name: "), c("display_name"), F.lit("\nSource: "), c("source_type"), F.lit("\nHeadline: "), F.when(F.coalesce(c("headline"), F.lit("")) != "", c("headline")).otherwise("none"),
        F.lit("\nOrgs: "), some(F.transform(c("organizations"), lambda o: o["name"]), 4), F.lit("\nLocations: "), some(c("locations"), 3), F.lit("\nTopics: "), some(c("topics"), 6),
        F.lit("\nBio excerpt: "), F.substring(F.coalesce(c("bio_text"), F.lit("")), 1, 300),
    )


def _features(names: list[str]) -> Column:
    return F.concat_ws("\n", *[F.concat(F.lit(f"  {n}: "), F.format_string("%.4f", F.coalesce(F.col(n).cast("double"), F.lit(0.0)))) for n in names])


def adjudication_prompt(names: list[str] = FULL) -> Column:
    """A question about the pair of structs ``l`` and ``r`` with features, ``score`` and ``decision``; the answer is to be JSON."""
    return F.concat(
        F.lit("Two public profiles were compared by a model. Say whether they are about the same person.\n\nProfile A\n"), profile_summary("l"), F.lit("\n\nProfile B\n"), profile_summary("r"),
        F.lit("\n\nFeatures\n"), _features(names), F.lit("\n\nScore of the model: "), F.format_string("%.4f", F.col("score")), F.lit(" (decision: "), F.col("decision"), F.lit(")\n\n"),
        F.lit('Answer with one JSON object: {"verdict": "match" or "non_match", "confidence": 0.0-1.0, "reasoning": "one or two sentences"}'),
    )


def explanation_prompt(names: list[str] = FULL) -> Column:
    return F.concat(
        F.lit("In two or three sentences, say why these profiles were decided as '"), F.col("decision"), F.lit("' (score "), F.format_string("%.3f", F.col("score")), F.lit(") and which evidence speaks for or against it.\n\nProfile A\n"),
        profile_summary("l"), F.lit("\n\nProfile B\n"), profile_summary("r"), F.lit("\n\nFeatures\n"), _features(names), F.lit("\n\nAnswer with plain text."),
    )


def ask(prompts: DataFrame, prompt: str, backend: Callable[[str], str] | None, out: str = "reply") -> DataFrame:
    """``prompts`` with the backend's reply; null without a backend and where it fails."""
    if backend is None:
        return prompts.withColumn(out, F.lit(None).cast("string"))

    @F.pandas_udf(StringType())
    def call(p: pd.Series) -> pd.Series:
        replies = []
        for x in p:
            try:
                replies.append(backend(x))
            except Exception:
                replies.append(None)
        return pd.Series(replies, dtype=object)

    return prompts.withColumn(out, call(prompt))


def read_reply(reply: str = "reply") -> Column:
    """(``verdict``, ``confidence``, ``reasoning``) of a reply, fenced or not; an unreadable one keeps the model's decision and score."""
    bare = F.regexp_replace(F.trim(F.coalesce(F.col(reply), F.lit(""))), r"^```(?:json)?\s*|\s*```$", "")
    j = F.from_json(bare, "verdict string, confidence double, reasoning string")
    good = j["verdict"].isin("match", "non_match") & j["confidence"].between(0, 1)
    return F.when(good, j).otherwise(F.struct(F.col("decision").alias("verdict"), F.col("score").cast("double").alias("confidence"), F.coalesce(F.col(reply), F.lit("")).alias("reasoning")))
