"""Candidate pairs. Every rule is an equi-join on exploded keys that gives exactly the pairs a comparison of all pairs would.

A key that ``m`` profiles share makes ``m (m - 1) / 2`` pairs, because the rule says so; ``max_df`` leaves out
keys with more profiles and is off unless asked for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinweave.durable import durable
from kinweave.functions.similarity import similarity_from
from kinweave.functions.text import norm_text

PAIR = ["left_profile_id", "right_profile_id"]


def share_keys(keys: DataFrame, column: str, at_least: int = 1, max_df: int | None = None) -> DataFrame:
    """Pairs of profiles (smaller id left) whose arrays in ``column`` have ``at_least`` common entries.

    Null arrays and null entries match nothing; entries of one array count once; an empty table gives no pairs.
    """
    k = keys.select(F.col("profile_id").alias("id"), F.explode(F.array_distinct(column)).alias("key")).filter("key is not null")
    # Keys of a single profile make no pair and are dropped before the join.
    n = k.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > 1)
    if max_df is not None:
        n = n.filter(F.col("n") <= max_df)
    k = k.join(n.select("key"), "key")
    met = k.alias("a").join(k.alias("b"), F.expr("a.key = b.key and a.id < b.id")).select(F.col("a.id").alias(PAIR[0]), F.col("b.id").alias(PAIR[1]))
    if at_least == 1:
        return met.distinct()
    return met.groupBy(*PAIR).agg(F.count("*").alias("n")).filter(F.col("n") >= at_least).select(*PAIR)


def alias_or_initial(keys: DataFrame, **how) -> DataFrame:
    return share_keys(keys, "variants", **how)


def shared_domain(keys: DataFrame, **how) -> DataFrame:
    return share_keys(keys, "domains", **how)


def org_or_topic_overlap(keys: DataFrame, **how) -> DataFrame:
    """One common organisation token, or two common topic tokens."""
    return share_keys(keys, "org_tokens", **how).unionByName(share_keys(keys, "topic_tokens", 2, **how)).distinct()


def similar_name_pairs(names: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Ordered pairs (``a``, ``b``) of distinct names (``name``) whose sequence ratio, taken in this order, reaches ``threshold``.

    Two such names of total length ``T`` share at least ``0.275 T - 1`` bigrams, repeats counted (for the
    default threshold; in general ``(3 t / 2 - 1) T - 1``). Bigrams are ordered by rarity and only as many of the
    rarest are joined as must hold a common one; names with ``T < 4`` are compared by their first letter.
    Both orders come out, as the ratio isn't symmetric.
    """
    share = 1.5 * threshold - 1
    n = names.select(norm_text(F.col("name")).alias("name")).filter("name <> ''").distinct().withColumn("len", F.length("name"))
    at = F.expr("transform(sequence(1, len - 1), i -> substring(name, i, 2))")
    # the k-th occurrence of a bigram is a token of its own, so common tokens count repeats
    numbered = F.expr("transform(g, (x, i) -> concat(x, '#', size(filter(slice(g, 1, i + 1), y -> y = x))))")
    long_ = n.filter("len > 1").withColumn("g", at).withColumn("tokens", numbered).select("name", "len", "tokens")
    df = long_.select(F.explode("tokens").alias("t")).groupBy("t").agg(F.count("*").alias("df"))
    e = long_.select("name", "len", F.explode("tokens").alias("t")).join(df, "t")
    # the least total length of a partner: it has at least t / (2 - t) of the length
    least = F.greatest(F.lit(1.0), share * (1 + threshold / (2 - threshold)) * F.col("len") - 1)
    keep = F.greatest(F.lit(1), (F.col("len") - 1 - F.ceil(least - 1e-9) + 1).cast("int"))
    rank = F.row_number().over(Window.partitionBy("name").orderBy("df", "t"))
    front = e.withColumn("k", rank).filter(F.col("k") <= keep).select("name", "len", "t")
    a, b = front.selectExpr("name as a", "len as la", "t"), front.selectExpr("name as b", "len as lb", "t")
    met = a.join(b, "t").filter(F.expr(f"a <> b and 2 * least(la, lb) >= {threshold} * (la + lb)")).select("a", "b", "la", "lb").distinct()
    ta, tb = long_.selectExpr("name as a", "tokens as ta"), long_.selectExpr("name as b", "tokens as tb")
    met = met.join(ta, "a").join(tb, "b").filter(F.size(F.array_intersect("ta", "tb")) >= share * (F.col("la") + F.col("lb")) - 1 - 1e-9).select("a", "b")
    short = n.filter("len <= 2")
    tiny = short.selectExpr("name as a", "len as la").join(short.selectExpr("name as b", "len as lb"), F.expr("la + lb < 4 and a <> b and substring(a, 1, 1) = substring(b, 1, 1)")).select("a", "b")
    # Spread over all cores: the comparison is the costly part, however few bytes the pairs are.
    pairs = met.unionByName(tiny).distinct().repartition(names.sparkSession.sparkContext.defaultParallelism, "a", "b")
    return pairs.withColumn("similarity", similarity_from(threshold)("a", "b")).filter(F.col("similarity") >= threshold)


def similar_profiles(keys: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Pairs of profiles with similar names that aren't equal (left name first)."""
    named = keys.select("profile_id", norm_text(F.col("display_name")).alias("name"))
    similar = similar_name_pairs(named, threshold)
    l, r = named.selectExpr("profile_id as left_profile_id", "name as a"), named.selectExpr("profile_id as right_profile_id", "name as b")
    return similar.join(l, "a").join(r, "b").filter("left_profile_id < right_profile_id").select(*PAIR)


def fuzzy_name(keys: DataFrame, threshold: float = 0.85, **how) -> DataFrame:
    """A common variant, two common name tokens, or similar names (left name first)."""
    # Equal names share a variant already.
    return alias_or_initial(keys, **how).unionByName(share_keys(keys, "name_tokens", 2, **how)).unionByName(similar_profiles(keys, threshold)).distinct()


RULES = {"fuzzy_name": fuzzy_name, "alias_or_initial": alias_or_initial, "shared_domain": shared_domain, "org_or_topic_overlap": org_or_topic_overlap}


#: The rules that are common entries of columns alone, as :mod:`pair_sets` counts them.
SHARED = {"alias_or_initial": [("variants", 1)], "shared_domain": [("domains", 1)], "org_or_topic_overlap": [("org_tokens", 1), ("topic_tokens", 2)]}


def rule_reasons(keys: DataFrame, rules: dict | None = None, **how) -> DataFrame:
    """(pair, ``reasons`` sorted array) of every pair that any rule gives."""
    every = None
    for name, rule in (rules or RULES).items():
        got = rule(keys, **how).withColumn("reason", F.lit(name))
        every = got if every is None else every.unionByName(got)
    return every.groupBy(*PAIR).agg(F.array_sort(F.collect_set("reason")).alias("reasons"))


def block(keys: DataFrame, neighbours: DataFrame | None = None, **how) -> DataFrame:
    """Candidates by rules and, if given, by nearest neighbours (``id``, ``other``): pairs with sorted reasons, a pair never with itself."""
    pairs = rule_reasons(keys, **how)
    if neighbours is not None:
        near = neighbours.filter("id <> other").select(F.least("id", "other").alias(PAIR[0]), F.greatest("id", "other").alias(PAIR[1]), F.array(F.lit("embedding_neighbor")).alias("reasons"))
        pairs = pairs.unionByName(near).groupBy(*PAIR).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("reasons")))).alias("reasons"))
    return pairs


def gold_pairs(profiles: DataFrame) -> DataFrame:
    """Pairs of profiles of one person; rows without a person are in none."""
    p = profiles.filter("canonical_person_id is not null").select("profile_id", "canonical_person_id").distinct()
    return (
        p.alias("a").join(p.alias("b"), F.expr("a.canonical_person_id = b.canonical_person_id and a.profile_id < b.profile_id"))
        .select(F.col("a.profile_id").alias(PAIR[0]), F.col("b.profile_id").alias(PAIR[1]))
    )


def blocking_recall(candidates: DataFrame, gold: DataFrame) -> DataFrame:
    """``gold``, ``found`` and ``recall``; recall is 0 without positives."""
    hit = gold.join(candidates.select(*PAIR).distinct().withColumn("hit", F.lit(1)), PAIR, "left")
    n = hit.agg(F.count("*").alias("gold"), F.coalesce(F.sum("hit"), F.lit(0)).cast("long").alias("found"))
    return n.withColumn("recall", F.when(F.col("gold") > 0, F.col("found") / F.col("gold")).otherwise(0.0))


def rule_holds(pairs: DataFrame, keys: DataFrame, threshold: float = 0.85) -> DataFrame:
    """``pairs`` with ``held``: whether any of :data:`RULES` gives the pair. It is looked up in the keys of the two, and no other pair is made."""
    sides = [keys.select(F.col("profile_id").alias(PAIR[i]), F.struct("variants", "name_tokens", "domains", "org_tokens", "topic_tokens", norm_text(F.col("display_name")).alias("name")).alias(x)) for i, x in enumerate("lr")]
    j = pairs.select(*PAIR).join(sides[0], PAIR[0]).join(sides[1], PAIR[1])
    common = lambda c, n: F.coalesce(F.size(F.array_intersect(f"l.{c}", f"r.{c}")) >= n, F.lit(False))
    shared = [common("name_tokens", 2), *[common(c, n) for rule in SHARED.values() for c, n in rule]]
    j = durable(j.select(*PAIR, F.greatest(*shared).alias("held"), F.col("l.name").alias("_a"), F.col("r.name").alias("_b")), "held")
    rest = j.filter("not held").withColumn("held", F.coalesce((F.col("_a") != F.col("_b")) & (similarity_from(threshold)("_a", "_b") >= threshold), F.lit(False)))
    return j.filter("held").unionByName(rest).drop("_a", "_b")


def recall_of(gold: DataFrame, held: DataFrame, near: DataFrame) -> DataFrame:
    """As :func:`blocking_recall` by the pairs that are ``held`` (:func:`rule_holds`) and, of the others, those that ``near`` (``id``, ``other``) has."""
    near = near.select(F.least("id", "other").alias(PAIR[0]), F.greatest("id", "other").alias(PAIR[1])).distinct()
    return blocking_recall(held.filter("held").unionByName(held.filter("not held").join(near, PAIR, "left_semi")), gold)


def volume_ratio(candidates: DataFrame, profiles: DataFrame) -> DataFrame:
    """``candidates`` over all possible pairs of profiles."""
    n = profiles.agg(F.count("*").alias("profiles"))
    c = candidates.agg(F.count("*").alias("candidates"))
    possible = F.greatest(F.lit(1), F.floor(F.col("profiles") * (F.col("profiles") - 1) / 2))
    return c.join(F.broadcast(n), F.lit(True)).select("candidates", "profiles", (F.col("candidates") / possible).alias("ratio"))


def rule_stats(candidates: DataFrame, gold: DataFrame) -> DataFrame:
    """For each reason its ``candidates``, ``true_positives`` and ``precision``."""
    c = candidates.join(gold.withColumn("hit", F.lit(1)), PAIR, "left").select(F.explode("reasons").alias("reason"), F.coalesce("hit", F.lit(0)).cast("long").alias("hit"))
    return c.groupBy("reason").agg(F.count("*").alias("candidates"), F.sum("hit").alias("true_positives"), F.avg("hit").alias("precision"))
