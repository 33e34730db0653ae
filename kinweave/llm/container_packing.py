"""Filling fixed-capacity containers with items of varying length (problem 8).

Method: vector bin packing by dot product. An item demands tokens, one segment, and loss-bearing tokens
(those after the first line, which states what the text is about). A container is filled by taking, of
the items that still fit in all three, the one whose demand has the largest dot product with what is
left, each relative to its limit; if none fits, the next container is opened.

Items are spread evenly over groups of about ``GROUP`` by a hash, so every group sees the whole
mixture of lengths and is packed in one task; what the grouping costs is at most one partly filled
container a group. An item above the capacity is cut into full pieces, which are containers of their
own, and a rest that is packed like any other; no other item is split.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.durable import durable
from kinweave.llm.tokens import VOCABULARY, measured

GROUP = 6000
#: Limits besides the capacity: segments, as capacity over this many tokens, and the loss-bearing share of the capacity.
#: An item that by itself is above the latter isn't split for it, as only the capacity splits; it counts as filling that limit.
TOKENS_PER_SEGMENT, LOSS_SHARE = 64, 0.9


def limits(capacity: int) -> tuple[int, int, int]:
    """Most tokens, segments and loss-bearing tokens of a container."""
    return capacity, max(1, capacity // TOKENS_PER_SEGMENT), max(1, int(LOSS_SHARE * capacity))


def pack(demand: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Container number of each item. ``demand``: items by dimensions, each within ``limit``; ties go to the earlier item."""
    n = len(demand)
    out = np.full(n, -1, np.int64)
    d = demand / limit
    left_items = np.lexsort((np.arange(n), -d[:, 0]))
    d = d[left_items]
    taken = np.zeros(n, bool)
    free, bin_no, open_ = np.ones(demand.shape[1]), 0, False
    columns = np.ascontiguousarray(d.T)
    alive = n
    while alive:
        fits = ~taken
        for c, f in zip(columns, free):
            fits &= c <= f + 1e-12
        score = np.where(fits, free @ columns, -1.0)
        i = int(score.argmax()) if len(score) else 0
        if score[i] < 0:
            if not open_:
                raise ValueError("an item exceeds the limits")
            free, bin_no, open_ = np.ones(demand.shape[1]), bin_no + 1, False
            if alive * 2 < len(taken):
                keep = ~taken
                left_items, columns, taken = left_items[keep], np.ascontiguousarray(columns[:, keep]), np.zeros(alive, bool)
            continue
        out[left_items[i]] = bin_no
        taken[i] = True
        alive -= 1
        open_ = True
        free = free - columns[:, i]
    return out


def _pack_group(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["doc_id", "piece"], ignore_index=True)
    capacity = int(pdf["capacity"].iloc[0])
    limit = np.array(limits(capacity), float)
    number = pack(np.minimum(np.stack([pdf["n_tokens"], np.ones(len(pdf)), pdf["loss_tokens"]], 1).astype(float), limit), limit)
    key = pdf["container_kind"] + "-" + pdf["grp"].map("{:06d}".format) + "-" + pd.Series(number).map("{:06d}".format)
    return pdf.assign(container_id=key)[["container_kind", "container_id", "doc_id", "piece", "start_token", "n_tokens", "loss_tokens", "capacity"]]


def packed(docs: DataFrame, containers: DataFrame, vocabulary: str = VOCABULARY, group: int = GROUP) -> DataFrame:
    """Pieces with their containers: (``container_kind``, ``container_id``, ``doc_id``, ``piece``, ``start_token``, ``n_tokens``, ``loss_tokens``, ``capacity``).

    Every document with a non-empty text is in one container of each kind, or, above the capacity, in
    several pieces that together are the text. A kind with a null or non-positive capacity is left out;
    repeated kinds count once. A repeated ``doc_id`` is an item each time. Empty tables give an empty result.
    """
    items = durable(measured(docs, ["doc_id"], vocabulary), "tokens")
    n = items.count()
    groups = max(1, math.ceil(n / group))
    kinds = containers.filter("capacity_tokens > 0").groupBy("container_kind").agg(F.max("capacity_tokens").cast("int").alias("capacity"))
    # One row per kind and document: the kinds are a fixed list, and each wants all documents.
    each = items.join(F.broadcast(kinds), F.col("n_tokens") > 0)
    fits = F.col("n_tokens") <= F.col("capacity")
    starts = F.when(fits, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("n_tokens") - 1, F.col("capacity")))
    pieces = each.withColumn("fits", fits).select("container_kind", "capacity", "doc_id", "n_tokens", "lead_tokens", "fits", F.posexplode(starts).alias("piece", "start_token"))
    length = F.when(F.col("fits"), F.col("n_tokens")).otherwise(F.least(F.col("capacity"), F.col("n_tokens") - F.col("start_token")))
    pieces = pieces.withColumn("len", length.cast("int"))
    head = F.greatest(F.lit(0), F.least(F.col("len"), F.col("lead_tokens") - F.col("start_token")))
    pieces = pieces.select("container_kind", "capacity", "doc_id", "piece", "start_token", F.col("len").alias("n_tokens"), (F.col("len") - head).cast("int").alias("loss_tokens"))
    pieces = pieces.withColumn("grp", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups)).cast("int"))
    return pieces.groupBy("container_kind", "grp").applyInPandas(
        _pack_group, "container_kind string, container_id string, doc_id long, piece int, start_token int, n_tokens int, loss_tokens int, capacity int"
    )


def fill_report(placed: DataFrame) -> DataFrame:
    """For each kind: ``containers``, ``items``, ``tokens``, ``fill`` (share of the capacity that is used)."""
    per = placed.groupBy("container_kind", "capacity", "container_id").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("k"))
    return per.groupBy("container_kind").agg(F.count("*").alias("containers"), F.sum("k").alias("items"), F.sum("t").alias("tokens"), (F.sum("t") / F.sum(F.col("capacity").cast("long"))).alias("fill"))


def limit_report(placed: DataFrame, docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """For each kind: ``documents`` placed, and what must be 0: ``broken`` (documents that aren't whole, or are split though they fit),
    ``over_tokens``, ``over_segments`` and ``over_loss`` (containers above a limit; for the last, unless one item alone is above it)."""
    sizes = measured(docs, ["doc_id"], vocabulary).groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.max("n_tokens").alias("longest"))
    doc = placed.groupBy("container_kind", "capacity", "doc_id").agg(F.sum("n_tokens").alias("t"), F.max("piece").alias("pieces")).join(sizes, "doc_id")
    broken = (F.col("t") != F.col("n")) | ((F.col("pieces") > 0) & (F.col("longest") <= F.col("capacity")))
    whole = doc.groupBy("container_kind").agg(F.count("*").alias("documents"), F.sum(broken.cast("long")).alias("broken"))
    box = placed.groupBy("container_kind", "capacity", "container_id").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("k"), F.sum("loss_tokens").alias("loss"), F.max("loss_tokens").alias("most"))
    segments, loss = F.greatest(F.lit(1), F.floor(F.col("capacity") / TOKENS_PER_SEGMENT)), F.greatest(F.lit(1), F.floor(F.col("capacity") * LOSS_SHARE))
    over = {"over_tokens": F.col("t") > F.col("capacity"), "over_segments": F.col("k") > segments, "over_loss": (F.col("loss") > loss) & (F.col("most") <= loss)}
    return whole.join(box.groupBy("container_kind").agg(*[F.sum(c.cast("long")).alias(n) for n, c in over.items()]), "container_kind")
