"""Splits that keep related records together (problem 2).

Method: Borůvka-style minimum-edge contraction. Every vertex picks its lightest edge, the picked
edges join a spanning forest that is written to the shared folder, and the graph is contracted to
the roots of what was joined, until no edge is left. Roots are put into bands by the number of rows
below them and dealt to the splits systematically inside each band. Roots too large to be dealt
(a share of all rows above ``giant_share``; there are at most ``1 / giant_share`` of them) are
placed first, each in the split that lacks most.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.durable import durable, release

#: Splits and their shares.
SPLITS = (("train", 0.6), ("validation", 0.2), ("test", 0.2))
#: Roots in a sub-list of a band that is numbered on its own, so that no task sorts a whole band.
LANE_ROOTS = 250_000
GOLDEN = 0.6180339887498949


def id_key(c: Column) -> Column:
    """An id without case, outer white space and differences between ``-``, blank and ``_``; null if empty or 'unknown'."""
    k = F.regexp_replace(F.lower(F.trim(c)), r"[\s-]+", "_")
    return F.when((k != "") & (k != "unknown"), k)


def boruvka_forest(edges: DataFrame, max_rounds: int = 64) -> tuple[DataFrame, DataFrame]:
    """(membership, forest) of an undirected graph with edges (``u``, ``v``, ``w``).

    membership is (``node``, ``root``) for every vertex with an edge; forest is (``u``, ``v``, ``w``,
    ``round``), the picked edges: they connect what the graph connects and hold no cycle. Equal
    weights are ordered by the ids, so the forest is unique. Null ends and self loops are dropped,
    of repeated edges the lightest stays, a null weight counts as the heaviest. Both results are
    written tables.
    """
    spark = edges.sparkSession
    e = edges.select("u", "v", F.coalesce(F.col("w").cast("double"), F.lit(float("inf"))).alias("w")).filter("u <> v")
    e = e.groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.min("w").alias("w"))
    # a, b: the ends after contraction; u, v: the edge as given
    e = durable(e.selectExpr("u as a", "v as b", "u", "v", "w"), "edges")
    member, picked = None, []
    for turn in range(max_rounds):
        if e.isEmpty():
            break
        ends = e.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other")), F.struct(F.col("b").alias("node"), F.col("a").alias("other")))).alias("x"), "u", "v", "w")
        best = durable(ends.groupBy("x.node").agg(F.min(F.struct("w", "u", "v", "x.other")).alias("m")).select("node", "m.w", "m.u", "m.v", "m.other"), "best")
        picked.append(durable(best.select("u", "v", "w").distinct().withColumn("round", F.lit(turn)), "forest"))
        # Of two vertices that picked each other the smaller is the root; all others hang on what they picked.
        far = best.select(F.col("node").alias("other"), F.col("other").alias("back"))
        up = best.join(far, "other").select("node", F.when((F.col("back") == F.col("node")) & (F.col("node") < F.col("other")), F.col("node")).otherwise(F.col("other")).alias("root"))
        up = durable(up, "up")
        while True:
            over = up.select(F.col("node").alias("root"), F.col("root").alias("top"))
            jumped = durable(up.join(over, "root").select("node", F.col("top").alias("root"), (F.col("top") != F.col("root")).alias("moved")), "up")
            release(up)
            up = jumped.drop("moved")
            up._kinweave_path = jumped._kinweave_path
            if jumped.filter("moved").isEmpty():
                break
        at_a, at_b = up.selectExpr("node as a", "root as ra"), up.selectExpr("node as b", "root as rb")
        nxt = e.join(at_a, "a").join(at_b, "b").filter("ra <> rb").selectExpr("least(ra, rb) as a", "greatest(ra, rb) as b", "u", "v", "w")
        nxt = nxt.groupBy("a", "b").agg(F.min(F.struct("w", "u", "v")).alias("m")).selectExpr("a", "b", "m.u", "m.v", "m.w")
        nxt = durable(nxt, "edges")
        if member is None:
            member = up
        else:
            over = up.select(F.col("node").alias("root"), F.col("root").alias("top"))
            grown = durable(member.join(over, "root", "left").select("node", F.coalesce("top", "root").alias("root")), "member")
            release(member, up)
            member = grown
        release(e, best)
        e = nxt
    else:
        raise RuntimeError(f"edges left after {max_rounds} rounds")
    release(e)
    if member is None:
        return spark.createDataFrame([], "node string, root string"), spark.createDataFrame([], "u string, v string, w double, round int")
    forest = picked[0]
    for p in picked[1:]:
        forest = forest.unionByName(p)
    return member, forest


def deal_roots(sizes: DataFrame, splits=SPLITS, giant_share: float = 0.002) -> DataFrame:
    """Give every (``root``, ``n``) a ``split``, so that rows come near the shares of ``splits``.

    Roots with more than ``giant_share`` of all rows are placed one by one, largest first; they are
    at most ``1 / giant_share``, which bounds what the driver sees. The others are numbered inside
    bands of like size (powers of two); number k takes the split in which the fraction of
    ``k * golden ratio`` falls, which spreads every split evenly over each band. Ties in size are
    ordered by a hash of the root, so equal input gives equal splits. Empty input gives an empty result.
    """
    names, shares = [s for s, _ in splits], [p for _, p in splits]
    count, total = (x or 0 for x in sizes.agg(F.count("*"), F.sum("n")).first())
    n_lanes = max(8, math.ceil(count / LANE_ROOTS))
    limit = max(1.0, total * giant_share)
    giants = sorted(((r["n"], r["root"]) for r in sizes.filter(F.col("n") > limit).collect()), reverse=True)
    got = [0] * len(names)
    placed = []
    for n, root in giants:
        k = max(range(len(names)), key=lambda i: (shares[i] * total - got[i], -i))
        got[k] += n
        placed.append((root, names[k]))
    rest = [max(0.0, p * total - g) for p, g in zip(shares, got)]
    rest = [x / (sum(rest) or 1) for x in rest]
    small = sizes.filter(F.col("n") <= limit).select(
        "root",
        F.floor(F.log2("n")).cast("int").alias("band"),
        F.xxhash64("root").alias("h"),
    ).withColumn("lane", F.pmod("h", F.lit(n_lanes)).cast("int"))
    # At most 64 bands times the lanes.
    lanes = {(r["band"], r["lane"]): r["count"] for r in small.groupBy("band", "lane").count().collect()}
    start, at = [], 0
    for key in sorted(lanes, reverse=True):
        start.append((*key, at))
        at += lanes[key]
    spark = sizes.sparkSession
    offsets = spark.createDataFrame(start, "band int, lane int, start long")
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy("band", "lane").orderBy("h", "root")) + F.col("start")
    turn = k * F.lit(GOLDEN)
    turn = turn - F.floor(turn)
    split, upto = F.lit(names[-1]), 1.0
    for name, share in reversed(list(zip(names[:-1], rest[:-1]))):
        upto = sum(rest[: names.index(name) + 1])
        split = F.when(turn < upto, name).otherwise(split)
    dealt = small.join(F.broadcast(offsets), ["band", "lane"]).select("root", split.alias("split"))
    return dealt.unionByName(spark.createDataFrame(placed, "root string, split string")) if placed else dealt


def person_graph(profiles: DataFrame, examples: DataFrame) -> DataFrame:
    """Edges between rows and persons: profile with canonical id, left profile with left canonical id.

    Nodes are ``c:`` + id key and ``p:`` + profile id. An edge weighs less the more rows state it.
    """
    a = profiles.select(F.trim("profile_id").alias("p"), id_key(F.col("canonical_person_id")).alias("c"))
    b = examples.select(F.trim("left_profile_id").alias("p"), id_key(F.col("left_canonical_id")).alias("c"))
    both = a.unionByName(b).filter("p is not null and p <> ''").groupBy("p", "c").count()
    # A profile without a person is a vertex of its own; a self loop would drop out of the forest, so it is handled by the caller.
    return both.filter("c is not null").select(F.concat(F.lit("c:"), "c").alias("u"), F.concat(F.lit("p:"), "p").alias("v"), (1.0 / F.col("count")).alias("w"))


def row_nodes(profiles: DataFrame, examples: DataFrame) -> DataFrame:
    """One row for each row of both tables: ``tbl``, ``profile_id``, ``right_profile_id``, ``person`` (id key), ``node``, ``delivered``."""
    def node(p, c):
        return F.coalesce(F.concat(F.lit("p:"), F.when(F.trim(p) != "", F.trim(p))), F.concat(F.lit("c:"), c), F.lit("p:"))

    pc, ec = id_key(F.col("canonical_person_id")), id_key(F.col("left_canonical_id"))
    a = profiles.select(F.lit("profiles").alias("tbl"), "profile_id", F.lit(None).cast("string").alias("right_profile_id"), pc.alias("person"), node(F.col("profile_id"), pc).alias("node"), F.lit(None).cast("string").alias("delivered"))
    b = examples.select(F.lit("pair_examples").alias("tbl"), F.col("left_profile_id").alias("profile_id"), "right_profile_id", ec.alias("person"), node(F.col("left_profile_id"), ec).alias("node"), F.lower(F.trim("split")).alias("delivered"))
    return a.unionByName(b)


def grouped_splits(profiles: DataFrame, examples: DataFrame, splits=SPLITS) -> DataFrame:
    """Every row of both tables with its ``root`` and new ``split``: no person is in two splits.

    A row without a person goes with its profile id, so repeats of it stay together and an
    unlabelled example goes where the profile's person went. Rows without any id form one group.
    """
    member, _ = boruvka_forest(person_graph(profiles, examples))
    rows = row_nodes(profiles, examples).join(member, "node", "left").withColumn("root", F.coalesce("root", "node")).drop("node")
    dealt = deal_roots(durable(rows.groupBy("root").agg(F.count("*").alias("n")), "sizes"), splits)
    return rows.join(dealt, "root", "left")


def split_breaches(profiles: DataFrame, examples: DataFrame) -> DataFrame:
    """Persons whose rows as left person carry more than one delivered split: (``canonical_person_id``).

    The delivered splits are gathered over the rows below each root of the forest that :func:`grouped_splits` deals. Only
    below a root with more than one can a person have more than one, and there the persons are told apart. The id is
    written as in profiles (the smallest spelling), or as its key where profiles lack it.
    """
    member, _ = boruvka_forest(person_graph(profiles, examples))
    rows = row_nodes(profiles, examples).filter("tbl = 'pair_examples' and person is not null and delivered <> ''").groupBy("node", "person", "delivered").count()
    rows = durable(rows.join(member, "node", "left").select(F.coalesce("root", "node").alias("root"), "person", "delivered").distinct(), "delivered")
    broken = rows.groupBy("root").agg(F.min("delivered").alias("a"), F.max("delivered").alias("b")).filter("a <> b").select("root")
    below = rows.join(broken, "root", "left_semi").groupBy("root", "person").agg(F.min("delivered").alias("a"), F.max("delivered").alias("b")).filter("a <> b")
    spelt = profiles.select(id_key(F.col("canonical_person_id")).alias("person"), "canonical_person_id").filter("person is not null").groupBy("person").agg(F.min("canonical_person_id").alias("written"))
    return below.join(spelt, "person", "left").select(F.coalesce("written", "person").alias("canonical_person_id"))
