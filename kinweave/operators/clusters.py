"""Identities out of accepted pairs: components, names, organisations, links and confidence bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.durable import durable, release


def components(edges: DataFrame, left: str = "left_profile_id", right: str = "right_profile_id", vertices: DataFrame | None = None, max_rounds: int = 100) -> DataFrame:
    """(``profile_id``, ``entity_id``): the smallest id each vertex is connected with.

    Alternates two equi-joins: every neighbour larger than a vertex is linked to the smallest neighbour,
    then every smaller one is; edges become stars. A hub's neighbours are never collected. Nulls and self
    loops drop out; ``vertices`` (``profile_id``) without an edge are their own entity.
    """
    e = edges.select(F.col(left).alias("u"), F.col(right).alias("v")).filter("u <> v")
    e = durable(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large star: larger neighbours to the minimum
        big = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        big = durable(big, "large")
        # small star: smaller neighbours, and the vertex itself, to the minimum
        small_low = big.groupBy("u").agg(F.min("v").alias("m"))
        nxt = big.join(small_low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("x")).select("x.*").filter("u <> v").distinct()
        nxt = durable(nxt, "small")
        now = nxt.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        release(e, big)
        e = nxt
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components not stable after {max_rounds} rounds")
    labels = e.select(F.col("u").alias("profile_id"), F.col("v").alias("entity_id"))
    labels = labels.unionByName(labels.select(F.col("entity_id").alias("profile_id"), "entity_id").distinct())
    if vertices is not None:
        alone = vertices.select("profile_id").distinct().join(labels, "profile_id", "left_anti").select("profile_id", F.col("profile_id").alias("entity_id"))
        labels = labels.unionByName(alone)
    return labels


def confidence_band(mean: Column) -> Column:
    """high, medium, low or uncertain; uncertain without an accepted pair."""
    return F.when(mean >= 0.9, "high").when(mean >= 0.75, "medium").when(mean >= 0.6, "low").otherwise("uncertain")


def bands(labels: DataFrame, matches: DataFrame) -> DataFrame:
    """(``entity_id``, ``mean_score``, ``confidence_band``) from the mean score of the accepted pairs inside each entity."""
    inside = matches.join(labels.withColumnRenamed("profile_id", "left_profile_id"), "left_profile_id").groupBy("entity_id").agg(F.avg("score").alias("mean_score"))
    ids = labels.select("entity_id").distinct()
    return ids.join(inside, "entity_id", "left").select("entity_id", "mean_score", confidence_band(F.col("mean_score")).alias("confidence_band"))


def _top(rows: DataFrame, value: str, k: int, by_count: bool, alias: str) -> DataFrame:
    """The first ``k`` values of each entity, by count and first appearance, or by first appearance alone, as an array."""
    g = rows.groupBy("entity_id", value).agg(F.count("*").alias("n"), F.min(F.struct("profile_id", "pos")).alias("first"))
    order = [F.desc("n"), "first"] if by_count else ["first"]
    rank = F.row_number().over(Window.partitionBy("entity_id").orderBy(*order))
    kept = g.withColumn("k", rank).filter(F.col("k") <= k)
    return kept.groupBy("entity_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", value))), lambda x: x[value]).alias(alias))


def identities(labels: DataFrame, profiles: DataFrame, matches: DataFrame) -> DataFrame:
    """One row per entity: members, most frequent name, key organisations, topics and links, band; largest first.

    Profiles are in id order; ties go to what comes first. Blank values don't count. The members column
    lists all members, so an entity with very many is a long row; ``n_members`` says how many.
    """
    m = labels.join(profiles, "profile_id")
    pos = lambda c: m.select("entity_id", "profile_id", F.posexplode(c).alias("pos", "v"))
    names = m.filter("display_name is not null").select("entity_id", "profile_id", F.lit(0).alias("pos"), F.col("display_name").alias("v"))
    orgs = pos("organizations").select("entity_id", "profile_id", "pos", F.col("v.name").alias("v")).filter("trim(v) <> ''")
    topics, links = pos("topics").filter("trim(v) <> ''"), pos("outbound_links").filter("trim(v) <> ''")
    base = labels.groupBy("entity_id").agg(F.count("*").alias("n_members"), F.array_sort(F.collect_list("profile_id")).alias("member_profile_ids"))
    out = base.join(_top(names, "v", 1, True, "name"), "entity_id", "left").join(_top(orgs, "v", 3, True, "key_orgs"), "entity_id", "left")
    out = out.join(_top(topics, "v", 3, True, "key_topics"), "entity_id", "left").join(_top(links, "v", 3, False, "key_links"), "entity_id", "left").join(bands(labels, matches), "entity_id", "left")
    none = F.array().cast("array<string>")
    out = out.select("entity_id", "n_members", "member_profile_ids", F.get("name", F.lit(0)).alias("canonical_name"), *[F.coalesce(c, none).alias(c) for c in ("key_orgs", "key_topics", "key_links")], "confidence_band")
    return out.orderBy(F.desc("n_members"), "entity_id")


def network(profiles: DataFrame, labels: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (profile, entity, name, source) and edges (pair, decision, weight: 3 s for matches, s / 2 for abstentions) of the identity graph."""
    nodes = profiles.select("profile_id", "display_name", "source_type").join(labels, "profile_id", "left")
    weight = F.when(F.col("decision") == "match", 3 * F.col("score")).otherwise(0.5 * F.col("score"))
    return nodes, pairs.filter(F.col("decision").isin("match", "abstain")).select("left_profile_id", "right_profile_id", "decision", weight.alias("weight"))
