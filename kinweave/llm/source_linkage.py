"""Matching entities across sources without keys (problem 5).

Method: label-model linkage. Candidate pairs come from two joins: an initial with a surname at most three
edits away (:func:`name_vectors.edit_pairs`), and a link of one's own. Matching functions vote on each candidate: name, link, organisation and
place, each with a few levels, among them "can't tell" and "contradicts". A generative model (:mod:`label_model`) learns
from the table of vote patterns how often each level occurs among matches and non-matches, and which
voters depend on each other; its posterior is the confidence.

Where one side states which of its records belong to one person, the votes for these are pooled, so a
thin record is compared with everything that is known of the person.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.durable import durable
from kinweave.llm.forest_split import id_key
from kinweave.llm.label_model import LabelModel
from kinweave.llm.name_vectors import blocked_join, edit_pairs
from kinweave.llm.people import people_features, records

NAME, LINK, ORG, PLACE = range(4)
LEVELS = [6, 4, 5, 4]
#: Odds for a match that each level starts with, before anything is learned.
LEAN = [[0.01, 0.02, 0.3, 0.8, 3, 4], [0.02, 0.8, 0.1, 60], [0.3, 0.9, 0.9, 3, 8], [0.4, 0.9, 0.9, 4]]


def sure(v) -> int | None:
    """What needs no learning: a shared link and a name that doesn't contradict; another name and no shared link."""
    if v[LINK] == 3 and v[NAME] >= 2:
        return 1
    if v[LINK] != 3 and v[NAME] <= 1:
        return 0
    return None


#: The votes that are surely no match in :func:`sure`, whatever is learned.
STRUCK = f"v{LINK} <> 3 and v{NAME} <= 1"


def link_pairs(links: DataFrame) -> DataFrame:
    """Pairs (``l``, ``r``) of records of side 0 and side 1 that state a link of their own in common."""
    on = lambda k, name: links.filter(F.col("side") == k).select(F.col("link").alias("key"), F.col("id").alias(name)).distinct()
    return blocked_join(on(0, "l"), on(1, "r")).select("l", "r").distinct()


def name_level(a: Column, b: Column) -> Column:
    """How well the names of two records agree, from 0 (other surname) to 5 (equal)."""

    def level(x: Column, y: Column) -> Column:
        sd = F.levenshtein(x["s"], y["s"], 3)
        size = F.least(F.length(x["s"]), F.length(y["s"]))
        near = ((sd > 0) & (sd < 3) & (size >= 6)) | ((sd == 3) & (size >= 9))
        one = (F.length(x["g"]) <= 1) | (F.length(y["g"]) <= 1)
        initial = F.arrays_overlap(F.transform(x["alts"], lambda v: F.substring(v, 1, 1)), F.transform(y["alts"], lambda v: F.substring(v, 1, 1)))
        gd = F.levenshtein(x["g"], y["g"], 2)
        same = F.array_contains(x["alts"], y["g"]) | F.array_contains(y["alts"], x["g"])
        short = F.least(F.length(x["g"]), F.length(y["g"]))
        typo = ((gd == 1) & (short >= 4)) | ((gd == 2) & (short >= 7)) | ((short >= 3) & (x["g"].startswith(y["g"]) | y["g"].startswith(x["g"])))
        given = F.when(~one & (same | typo), 2).when(one & (initial | (x["g"] == "") | (y["g"] == "")), 1).otherwise(0)
        return (
            F.when(sd == 0, F.when(given == 2, 5).when(given == 1, 3).otherwise(1))
            .when(near, F.when(given == 2, 4).when(given == 1, 2).otherwise(1))
            .otherwise(0)
        )

    return F.coalesce(F.array_max(F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: level(x, y))))), F.lit(0))


def link_level(a: str, b: str) -> Column:
    """0: other links of one's own on one host; 1: one side has none; 2: others, on other hosts; 3: one in common."""
    own = F.arrays_overlap(f"{a}.own", f"{b}.own")
    host = F.arrays_overlap(f"{a}.hosts", f"{b}.hosts")
    none = (F.size(f"{a}.own") == 0) | (F.size(f"{b}.own") == 0)
    return F.when(own, 3).when(none, 1).when(host, 0).otherwise(2)


def word_level(a: str, b: str, words: str, most: int) -> Column:
    """0: none in common; 1: one side has none at all; 2: common words only; from 3: so many others, up to level ``most``."""
    one = lambda t: (F.size(f"{t}.{words}") == 0) & (F.size(f"{t}.common_{words}") == 0)
    n = F.size(F.array_intersect(f"{a}.{words}", f"{b}.{words}"))
    return F.when(one(a) | one(b), 1).when(n > 0, F.least(F.lit(most), n + 2)).when(F.arrays_overlap(f"{a}.common_{words}", f"{b}.common_{words}"), 2).otherwise(0)


def pair_votes(pairs: DataFrame, left: DataFrame, right: DataFrame, more=lambda a, b: {}) -> DataFrame:
    """``pairs`` (``l``, ``r``, other columns) with the votes of the matching functions."""
    a, b = left.select(F.col("id").alias("l"), F.struct("*").alias("a")), right.select(F.col("id").alias("r"), F.struct("*").alias("b"))
    met = pairs.join(a, "l").join(b, "r")
    votes = {"v0": name_level(F.col("a.names"), F.col("b.names")), "v1": link_level("a", "b"), "v2": word_level("a", "b", "orgs", 4), "v3": word_level("a", "b", "places", 3)}
    return met.withColumns(votes | more("a", "b")).drop("a", "b")


def posteriors(votes: DataFrame, levels: list[int] = LEVELS, lean: list[list[float]] = LEAN, anchor=sure, more: Iterable[Sequence[int]] = ()) -> tuple[DataFrame, LabelModel]:
    """``votes`` with ``confidence``, and the fitted model. Only the table of vote patterns is collected. ``more``: patterns, each
    with its number behind it, that the model learns from too and ``votes`` hasn't."""
    names = [f"v{i}" for i in range(len(levels))]
    rows = [tuple(r) for r in votes.groupBy(*names).agg(F.count("*").alias("n")).collect()]  # at most the product of the levels
    rows += map(tuple, more)
    model = LabelModel(levels, lean, anchor=anchor)
    v = np.array([r[:-1] for r in rows], int).reshape(len(rows), len(names))
    p = model.fit(v, np.array([r[-1] for r in rows], float))
    if not rows:
        return votes.withColumn("confidence", F.lit(0.0)), model
    table = votes.sparkSession.createDataFrame([(*map(int, r), float(x)) for r, x in zip(v, p)], ", ".join(f"{c} int" for c in names) + ", confidence double")
    return votes.join(F.broadcast(table), names), model


def persons_of(profiles: DataFrame, links: DataFrame) -> DataFrame:
    """(``r``, ``person``, ``named``): the person a record states; by a link of its own if exactly one person has it; else the record itself."""
    stated = profiles.select(F.col("profile_id").alias("r"), id_key(F.col("canonical_person_id")).alias("c")).groupBy("r").agg(F.max("c").alias("c"))
    own = links.filter("side = 1").select(F.col("id").alias("r"), "link")
    by_link = own.join(stated.filter("c is not null"), "r").groupBy("link").agg(F.min("c").alias("c1"), F.max("c").alias("c2")).filter("c1 = c2")
    lent = own.join(stated.filter("c is null").select("r"), "r").join(by_link, "link").groupBy("r").agg(F.min("c1").alias("a"), F.max("c1").alias("b")).filter("a = b")
    return stated.join(lent, "r", "left").select("r", F.coalesce(F.concat(F.lit("c:"), F.coalesce("c", "a")), F.concat(F.lit("r:"), "r")).alias("person"), (F.coalesce("c", "a").isNotNull()).alias("named"))


def link_sources(live: DataFrame, profiles: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Matching records of the two tables: (``left_profile_id``, ``right_profile_id``, ``confidence``).

    Both tables have the columns of profiles. A record without a name can match by its links only; one
    without name and links matches nothing. Repeated deliveries count once; null ids are left out.
    A live record goes to one of the persons that profiles names, the likeliest; ties go to the
    smaller id. Empty tables give an empty result.
    """
    feats, links = people_features(records(live, 0, topics=False).unionByName(records(profiles, 1, topics=False)))
    side = lambda df, k: df.filter(F.col("side") == k).drop("side")
    pairs = edit_pairs(feats).unionByName(link_pairs(links)).distinct()
    votes = pair_votes(pairs, side(feats, 0), side(feats, 1))
    persons = durable(persons_of(profiles, links), "persons")
    # A contradicting link counts only where no link is shared.
    pooled = votes.join(persons, "r").groupBy("l", "person", "named").agg(
        F.max("v0").alias("v0"), F.when(F.max("v1") == 3, 3).when(F.min("v1") == 0, 0).otherwise(F.max("v1")).alias("v1"), F.max("v2").alias("v2"), F.max("v3").alias("v3")
    )
    pooled = durable(pooled, "votes")
    scored, _ = posteriors(pooled)
    best = F.row_number().over(Window.partitionBy("l", "named").orderBy(F.desc("confidence"), "person"))
    kept = scored.filter(F.col("confidence") >= threshold).withColumn("k", best).filter("k = 1 or not named").select("l", "person", "confidence")
    return kept.join(persons, "person").select(F.col("l").alias("left_profile_id"), F.col("r").alias("right_profile_id"), "confidence")
