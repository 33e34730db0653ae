"""The pN_ queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm.canonical_map import map_profiles
from kinweave.llm.container_packing import fill_report, limit_report, packed
from kinweave.llm.cut_texts import cut_documents, cut_rates
from kinweave.llm.forest_split import SPLITS, grouped_splits, split_breaches
from kinweave.llm.grid_components import decided_links, grid_components
from kinweave.llm.name_variants import linked_variants, variant_pairs
from kinweave.llm.page_body import main_runs
from kinweave.llm.set_pairs import profile_items, similar_pairs, similar_sets
from kinweave.llm.source_linkage import link_sources
from kinweave.llm.source_mix import mix_report, mixed


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return variant_pairs(_t(spark, d, "live_profiles"))


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    return linked_variants(_t(spark, d, "live_profiles")).select(F.col("id").alias("profile_id"), F.col("shown").alias("display_name"), F.col("cluster").alias("group_id"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return split_breaches(_t(spark, d, "profiles"), _t(spark, d, "pair_examples"))


def p2_splits(spark: SparkSession, d: str) -> DataFrame:
    return grouped_splits(_t(spark, d, "profiles"), _t(spark, d, "pair_examples"))


def p2_shares(spark: SparkSession, d: str) -> DataFrame:
    rows = p2_splits(spark, d).groupBy("tbl", "split").agg(F.count("*").alias("n_rows"), F.countDistinct("root").alias("n_groups"))
    return rows.select("tbl", "split", "n_rows", "n_groups")


def p2_persons(spark: SparkSession, d: str) -> DataFrame:
    """Each person with the number of its rows in both tables and of the splits these got: 1."""
    rows = p2_splits(spark, d).filter("person is not null")
    return rows.groupBy("person").agg(F.count("*").alias("n_rows"), F.countDistinct("split").alias("n_splits"))


def p2_balance(spark: SparkSession, d: str) -> DataFrame:
    """Whether the rows of each split are within two points of its share."""
    rows = p2_splits(spark, d).groupBy("split").agg(F.count("*").alias("n"))
    total = rows.agg(F.sum("n").alias("total"))
    share = F.create_map(*[F.lit(x) for pair in SPLITS for x in pair])
    return rows.crossJoin(F.broadcast(total)).select("split", (F.abs(F.col("n") / F.col("total") - share[F.col("split")]) <= 0.02).alias("within"))  # a row beside three


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = similar_pairs(profile_items(_t(spark, d, "profiles")))
    return pairs.select(F.col("left").alias("left_profile_id"), F.col("right").alias("right_profile_id"))


def p3_links(spark: SparkSession, d: str) -> DataFrame:
    return similar_sets(profile_items(_t(spark, d, "profiles"))).select(F.col("id").alias("profile_id"), F.col("cid").alias("class_id"), "links")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return main_runs(_t(spark, d, "raw_pages"))


def p5_matches(spark: SparkSession, d: str) -> DataFrame:
    return link_sources(_t(spark, d, "live_profiles"), _t(spark, d, "profiles"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_matches(spark, d).select("left_profile_id", "right_profile_id")


def p6_mapped(spark: SparkSession, d: str) -> DataFrame:
    return map_profiles(_t(spark, d, "profiles"), _t(spark, d, "org_reference"), _t(spark, d, "place_reference"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    named = _t(spark, d, "org_reference").select(F.lit("organization").alias("field"), F.col("name").alias("value"))
    named = named.unionByName(_t(spark, d, "place_reference").select(F.lit("location").alias("field"), F.col("name").alias("value")))
    return p6_mapped(spark, d).join(F.broadcast(named.distinct()), ["field", "value"], "left_anti").select("profile_id", "field", "value", "ref_id")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return grid_components(decided_links(_t(spark, d, "resolved_pairs"))).select(F.col("vertex").alias("profile_id"), "group_id")


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return packed(_t(spark, d, "documents"), _t(spark, d, "containers"))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    return fill_report(p8_containers(spark, d))


def p8_limits(spark: SparkSession, d: str) -> DataFrame:
    return limit_report(p8_containers(spark, d), _t(spark, d, "documents"))


def p9_kept(spark: SparkSession, d: str) -> DataFrame:
    """For each source whether its share of the tokens is within half a point of the target, and documents above the allowed repeats: 0."""
    targets = _t(spark, d, "mix_targets").select("source", "target_share", "max_repeats")
    mix = p9_mix(spark, d)
    total = mix.agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("total"))
    per = mix.join(F.broadcast(targets), "source").groupBy("source").agg(
        F.sum(F.col("n_tokens") * F.col("repeats")).alias("t"), F.first("target_share").alias("target"), F.sum((F.col("repeats") > F.col("max_repeats")).cast("long")).alias("over_repeats")
    )
    return per.crossJoin(F.broadcast(total)).select("source", (F.abs(F.col("t") / F.col("total") - F.col("target")) <= 0.005).alias("within"), "over_repeats")  # a row beside each source


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    mix, _ = mixed(_t(spark, d, "documents"), _t(spark, d, "mix_targets"))
    return mix.filter("repeats > 0").select("doc_id", "source", "n_tokens", "repeats")


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    targets = _t(spark, d, "mix_targets")
    return mix_report(mixed(_t(spark, d, "documents"), targets)[0], targets)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return cut_documents(_t(spark, d, "documents"))


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    return cut_rates(_t(spark, d, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k[0] == "p" and k[1].isdigit() and callable(f)}


#: What DuckDB can check by value.
SQL: dict[str, str] = {
    "p2_found": """
WITH e AS (
  SELECT regexp_replace(lower(trim(left_canonical_id)), '[\\s-]+', '_', 'g') AS person, lower(trim(split)) AS s FROM pair_examples
), b AS (SELECT person FROM e WHERE person <> '' AND person <> 'unknown' GROUP BY person HAVING count(DISTINCT s) > 1),
w AS (SELECT regexp_replace(lower(trim(canonical_person_id)), '[\\s-]+', '_', 'g') AS person, min(canonical_person_id) AS written FROM profiles WHERE canonical_person_id IS NOT NULL GROUP BY 1)
SELECT coalesce(w.written, b.person) AS canonical_person_id FROM b LEFT JOIN w USING (person)""",
    "p2_persons": """
WITH a AS (SELECT canonical_person_id AS c FROM profiles UNION ALL SELECT left_canonical_id FROM pair_examples),
k AS (SELECT regexp_replace(lower(trim(c)), '[\\s-]+', '_', 'g') AS person FROM a)
SELECT person, count(*) AS n_rows, 1::BIGINT AS n_splits FROM k WHERE person <> '' AND person <> 'unknown' GROUP BY person""",
    "p2_balance": "SELECT unnest(['train', 'validation', 'test']) AS split, true AS within",
    "p8_limits": """
SELECT DISTINCT container_kind, (SELECT count(DISTINCT doc_id) FROM documents WHERE text <> '') AS documents, 0::BIGINT AS broken, 0::BIGINT AS over_tokens,
  0::BIGINT AS over_segments, 0::BIGINT AS over_loss FROM containers WHERE capacity_tokens > 0""",
    "p9_kept": "SELECT source, true AS within, 0::BIGINT AS over_repeats FROM mix_targets WHERE target_share > 0",
    "p3_found": """
WITH r AS (
  SELECT profile_id AS id, 't:' || trim(regexp_replace(lower(x), '\\s+', ' ', 'g')) AS item FROM (SELECT profile_id, unnest(topics) AS x FROM profiles)
  UNION SELECT profile_id, 'o:' || trim(regexp_replace(lower(x.name), '\\s+', ' ', 'g')) FROM (SELECT profile_id, unnest(organizations) AS x FROM profiles)
  UNION SELECT profile_id, 'l:' || regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(lower(x)), '[?#].*$', ''), '^[a-z][a-z0-9+.-]*://', ''), '^www\\.', ''), '/+$', '')
    FROM (SELECT profile_id, unnest(outbound_links) AS x FROM profiles)
), i AS (SELECT id, item FROM r WHERE length(item) > 2), n AS (SELECT id, count(*) AS n FROM i GROUP BY id HAVING count(*) >= 4),
c AS (SELECT a.id AS l, b.id AS r, count(*) AS c FROM i a JOIN i b ON a.item = b.item AND a.id < b.id GROUP BY 1, 2)
SELECT l AS left_profile_id, r AS right_profile_id FROM c JOIN n x ON x.id = l JOIN n y ON y.id = r WHERE c >= 0.6 * (x.n + y.n - c)""",
    "p7_found": """
WITH RECURSIVE t AS (
  SELECT least(left_profile_id, right_profile_id) AS u, greatest(left_profile_id, right_profile_id) AS v, resolved_at,
         CASE WHEN lower(regexp_replace(decision, '[^A-Za-z]+', '', 'g')) = 'match' THEN 1 ELSE 0 END AS m
  FROM resolved_pairs WHERE left_profile_id <> right_profile_id
), k AS (SELECT u, v, m, rank() OVER (PARTITION BY u, v ORDER BY resolved_at DESC NULLS LAST) AS r FROM t),
e AS (SELECT u, v FROM k WHERE r = 1 GROUP BY u, v HAVING max(m) = 1),
b AS (SELECT u AS x, v AS y FROM e UNION ALL SELECT v, u FROM e),
c AS (SELECT x, x AS y FROM b UNION SELECT c.x, b.y FROM c JOIN b ON b.x = c.y)
SELECT x AS profile_id, min(y) AS group_id FROM c GROUP BY x""",
}
