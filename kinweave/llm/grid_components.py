"""Consolidating pairwise matches into groups (problem 7).

Method: a two-dimensional grid. Vertices are hashed into ``g`` blocks, so an edge belongs to one of
``g * g`` block-pair cells. Every cell runs a local union-find and hands out a representative for
each of its vertices. A vertex meets up to ``2 g - 1`` cells, its row and its column; the smallest
representative becomes its parent, and every other one is linked to that parent by an edge of the
next, contracted graph. Rounds go on until no vertex has two representatives, that is until the
parents are stable. Labels are then composed from the last round back to the first.

Nothing is collected: per round the driver sees one count and the sizes of the ``g * g`` cells.
A task holds the vertices of one cell, never all edges of a hub: edges are folded into the local
forest batch by batch, and a cell with far more edges than the rest is salted over several tasks
(any placement of edges is right, as shared vertices are reconciled by the exchange).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.durable import durable, release

#: Edges that a task folds at once, and the edges a cell is sized for.
FOLD_ROWS = 200_000
CELL_EDGES = 60_000


def min_labels(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """Label of each of ``n`` vertices: the smallest vertex it is connected with."""
    parent = np.arange(n)
    while len(u):
        pu, pv = parent[u], parent[v]
        open_ = pu != pv
        if not open_.any():
            break
        u, v, pu, pv = u[open_], v[open_], pu[open_], pv[open_]
        np.minimum.at(parent, np.maximum(pu, pv), np.minimum(pu, pv))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
    return parent


def _fold(u: np.ndarray, v: np.ndarray) -> pd.DataFrame:
    codes, names = pd.factorize(np.concatenate([u, v]), sort=True)
    label = min_labels(codes[: len(u)], codes[len(u) :], len(names))
    # A root is its own representative here; it may have another one in another cell.
    return pd.DataFrame({"vertex": np.asarray(names), "root": np.asarray(names)[label]})


def _local_forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    forest, held, rows = None, [], 0
    for b in batches:
        held.append((b["u"].to_numpy(), b["v"].to_numpy()))
        rows += len(b)
        if rows >= FOLD_ROWS:
            if forest is not None:
                held.append((forest["vertex"].to_numpy(), forest["root"].to_numpy()))
            forest, held, rows = _fold(np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held])), [], 0
    if held:
        if forest is not None:
            held.append((forest["vertex"].to_numpy(), forest["root"].to_numpy()))
        forest = _fold(np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]))
    if forest is not None and len(forest):
        yield forest


def _by_cell(edges: DataFrame, n: int, cell_edges: int) -> DataFrame:
    """Edges placed by (row block, column block, salt), one cell or slice of a cell per partition."""
    g = max(1, math.ceil(math.sqrt(n / cell_edges)))
    if g == 1:
        return edges.coalesce(1) if n < cell_edges // 4 else edges.repartition(1)
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(g))
    cells = edges.withColumn("cell", block("u") * g + block("v"))
    # At most g * g rows, where g * g = n / cell_edges.
    sizes = cells.groupBy("cell").count().withColumn("slices", F.ceil(F.col("count") / F.lit(2 * cell_edges)))
    hot = sizes.filter("slices > 1").select("cell", "slices")
    salted = cells.join(F.broadcast(hot), "cell", "left").withColumn(
        "salt", F.pmod(F.xxhash64("v", "u"), F.coalesce(F.col("slices"), F.lit(1)))
    )
    return salted.repartition(g * g + g, "cell", "salt").select("u", "v")


def grid_components(edges: DataFrame, left: str = "u", right: str = "v", cell_edges: int = CELL_EDGES, max_rounds: int = 64) -> DataFrame:
    """Group id of every vertex that has at least one edge: (``vertex``, ``group_id``).

    ``group_id`` is the smallest vertex reachable, the vertex itself included. Edges are undirected.
    Nulls on either side, self loops and repeated edges change nothing; a vertex whose only edges
    are self loops or have a null side isn't in the result. An empty table gives an empty result.
    Extra columns are ignored, whatever their names.
    """
    e = edges.select(F.col(left).cast("string").alias("u"), F.col(right).cast("string").alias("v")).filter("u <> v")
    e = durable(e.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    levels: list[DataFrame] = []
    for _ in range(max_rounds):
        n = e.count()
        if not n:
            break
        reps = _by_cell(e, n, cell_edges).mapInPandas(_local_forest, "vertex string, root string")
        # The exchange of representatives: one row per vertex and cell, at most 2 g - 1 for a vertex.
        parents = reps.groupBy("vertex").agg(F.min("root").alias("parent"), F.collect_set("root").alias("roots"))
        level = durable(parents, "level")
        levels.append(level)
        nxt = level.filter("size(roots) > 1").select(F.explode("roots").alias("r"), F.col("parent").alias("p")).filter("r <> p")
        nxt = durable(nxt.select(F.least("r", "p").alias("u"), F.greatest("r", "p").alias("v")).distinct(), "edges")
        release(e)
        e = nxt
    else:
        raise RuntimeError(f"no stable parents after {max_rounds} rounds")
    release(e)
    if not levels:
        return edges.sparkSession.createDataFrame([], "vertex string, group_id string")
    labels = levels[-1].select("vertex", F.col("parent").alias("group_id"))
    for level in reversed(levels[:-1]):
        up = labels.select(F.col("vertex").alias("parent"), F.col("group_id").alias("top"))
        # a parent without an edge in the contracted graph is stable
        labels = durable(level.join(up, "parent", "left").select("vertex", F.coalesce("top", "parent").alias("group_id")), "labels")
    return labels


def decided_links(pairs: DataFrame) -> DataFrame:
    """Links of a table like resolved_pairs: (``u``, ``v``), one row per linked unordered pair.

    The row with the latest ``resolved_at`` speaks for a pair; among rows of the same time one that
    says match wins; a null time is earlier than any. A decision is match whatever its case and
    surrounding white space or punctuation; null isn't. Self pairs and pairs with a null id drop out.
    """
    word = F.lower(F.regexp_replace("decision", r"[^A-Za-z]+", ""))
    says = F.when(word == "match", 1).otherwise(0)
    at = F.coalesce(F.unix_micros(F.col("resolved_at").cast("timestamp")), F.lit(0))
    l, r = F.trim("left_profile_id"), F.trim("right_profile_id")
    return (
        pairs.select(F.least(l, r).alias("u"), F.greatest(l, r).alias("v"), (at * 2 + says).alias("word"), l.alias("l"), r.alias("r"))
        .filter("l <> r and l <> '' and r <> ''")
        .groupBy("u", "v")
        .agg(F.max("word").alias("word"))
        .filter("pmod(word, 2) = 1")
        .select("u", "v")
    )
