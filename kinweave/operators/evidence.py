"""Why a pair was decided as it was: signals, reason codes, explanation, and what would have to change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Messages of the counterfactuals, in order.
MESSAGES = {
    "shared_domain_count": "No shared personal domain or outbound link.", "org_overlap_count": "No overlapping organization evidence.", "topic_overlap_count": "Weak topical overlap.",
    "location_conflict": "Locations contradict each other.", "embedding_cosine": "Semantic text similarity is low.",
}


def select_span(spans: Column, field: str) -> Column:
    """The first span of a field, else the first of all, else null."""
    own = F.filter(spans, lambda s: s["field_name"] == field)
    return F.coalesce(F.get(own, F.lit(0)), F.get(spans, F.lit(0)))


def _f(c: str) -> Column:
    return F.coalesce(F.col(c).cast("double"), F.lit(0.0))


def supporting() -> Column:
    """(``code``, ``weight``) of the signals that speak for a match, in a fixed order."""
    s = lambda cond, code, w: F.when(cond, F.struct(F.lit(code).alias("code"), w.cast("double").alias("weight")))
    return F.array_compact(F.array(
        s(_f("name_similarity") >= 0.95, "high_name_similarity", F.least(_f("name_similarity"), F.lit(1.0))),
        s(_f("shared_domain_count") > 0, "shared_domain", F.lit(0.8)),
        s(_f("org_overlap_count") > 0, "shared_org", F.least(F.lit(1.0), 0.5 + 0.1 * _f("org_overlap_count"))),
        s(_f("topic_overlap_count") > 0, "shared_topics", F.least(F.lit(1.0), 0.4 + 0.1 * _f("topic_overlap_count"))),
    ))


def contradicting() -> Column:
    return F.array_compact(F.array(F.when(_f("location_conflict") >= 1, F.struct(F.lit("location_conflict").alias("code"), F.lit(0.9).cast("double").alias("weight")))))


def evidence_cards(decided: DataFrame) -> DataFrame:
    """``decided`` with ``supporting_signals``, ``contradicting_signals``, ``reason_codes`` and ``final_explanation``.

    Contradictions are left out of the reason codes of a match, not out of the explanation. Missing features count as 0.
    """
    out = decided.withColumn("supporting_signals", supporting()).withColumn("contradicting_signals", contradicting())
    for_, against = F.transform("supporting_signals", lambda x: x["code"]), F.transform("contradicting_signals", lambda x: x["code"])
    codes = F.when(F.col("decision") == "match", for_).otherwise(F.concat(for_, against))
    said = F.when(F.size(for_) > 0, F.array_join(for_, ", ")).otherwise("none")
    text = F.concat(
        F.lit("Decision="), "decision", F.lit(" at confidence "), F.format_string("%.2f", F.col("score")), F.lit(". Supporting signals: "), said, F.lit("."),
        F.when(F.size(against) > 0, F.concat(F.lit(" Contradictions: "), F.array_join(against, ", "), F.lit("."))).otherwise(""),
    )
    return out.withColumn("reason_codes", codes).withColumn("final_explanation", text)


def counterfactuals() -> Column:
    """Up to three reasons against a match, in a fixed order."""
    return F.slice(F.array_compact(F.array(
        F.when(_f("shared_domain_count") == 0, MESSAGES["shared_domain_count"]), F.when(_f("org_overlap_count") == 0, MESSAGES["org_overlap_count"]), F.when(_f("topic_overlap_count") <= 1, MESSAGES["topic_overlap_count"]),
        F.when(_f("location_conflict") >= 1, MESSAGES["location_conflict"]), F.when(_f("embedding_cosine") < 0.2, MESSAGES["embedding_cosine"]),
    )), 1, 3)
