"""All similar pairs between set-valued records (problem 3).

Method: minwise hashing. A set gets ``BANDS * ROWS`` minima of random hash functions; bands of
``ROWS`` minima are bucket keys; records that share a bucket are candidates, each pair once, unless
64-bit marks of the two sets prove that too little is common; the Jaccard similarity of what is left
is computed exactly from the sets.

Equal sets form one class and are compared once. A pair at the threshold 0.6 is missed with
probability ``(1 - 0.6 ** ROWS) ** BANDS`` = 0.00006, pairs above it far less often. Buckets with more
than ``HOT`` classes aren't paired off: inside them only classes that share a rare item are joined,
which loses nothing (two sets at the threshold share an item of their rarest-first prefixes), so
a value that a third of all rows has doesn't make all pairs of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.durable import durable
from kinweave.functions.text import link_key, norm_text

BANDS, ROWS = 40, 3
THRESHOLD = 0.6
#: Classes in a bucket above which its pairs are found by rare items.
HOT = 400
SEED = 20240501

_M = np.uint64(0xFFFFFFFFFFFFFFFF)


def _constants(n: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(SEED)
    return r.integers(1, 2**63, n, dtype=np.uint64) | np.uint64(1), r.integers(0, 2**63, n, dtype=np.uint64)


def band_keys(flat: np.ndarray, starts: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """Bucket keys, one row of ``bands`` for each set; ``flat`` holds 64-bit items, no set is empty."""
    mul, add = _constants(bands * rows)
    x = flat.astype(np.int64).view(np.uint64)
    out = np.empty((len(starts), bands), np.uint64)
    for b in range(bands):
        key = np.full(len(starts), np.uint64(b + 1))
        for r in range(rows):
            h = x * mul[b * rows + r] + add[b * rows + r]
            h ^= h >> np.uint64(32)
            h *= np.uint64(0xD6E8FEB86659FD93)
            low = np.minimum.reduceat(h, starts)
            key = (key ^ low) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(31)
        out[:, b] = key
    return out.view(np.int64)


def _bucket_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        items = b.column("items")
        if not len(items):
            continue
        offsets = items.offsets.to_numpy()
        flat = items.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
        keys = band_keys(flat, (offsets[:-1] - offsets[0]).astype(np.int64))
        n = keys.shape[1]
        bits = np.uint64(1) << ((flat.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(58))
        marks = np.bitwise_or.reduceat(bits, (offsets[:-1] - offsets[0]).astype(np.int64)).view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys.ravel()), pa.array(np.repeat(b.column("cid").to_numpy(), n)), pa.array(np.repeat(np.diff(offsets).astype(np.int32), n)), pa.array(np.repeat(marks, n))],
            names=["bucket", "cid", "n", "m"],
        )


def similar_classes(classes: DataFrame, threshold: float = THRESHOLD, hot: int = HOT) -> DataFrame:
    """Pairs (``l``, ``r``, ``jaccard``) of classes (``cid`` long, ``items`` array of longs, distinct), ``l < r``."""
    rows = classes.filter("size(items) > 0").select("cid", "items").mapInArrow(_bucket_rows, "bucket long, cid long, n int, m long")
    # m marks each item in one of 64 bits: a mark that only one side has is an item that isn't common. The bound is never too low.
    common = "least(l.n - bit_count(l.m & ~r.m), r.n - bit_count(r.m & ~l.m))"
    close = f"{common} >= {threshold / (1 + threshold)!r} * (l.n + r.n) - 1e-9"
    # Members of a bucket stand in one partition; of each only the count of those before it is needed to see what is hot.
    buckets = rows.repartition("bucket")
    sizes = buckets.groupBy("bucket").agg(F.count("*").alias("members")).filter("members > 1")
    shared = durable(buckets.join(sizes, "bucket"), "buckets")
    usual, crowded = shared.filter(f"members <= {hot}"), shared.filter(f"members > {hot}")
    pairs = usual.alias("l").join(usual.alias("r"), F.expr(f"l.bucket = r.bucket and l.cid < r.cid and {close}")).select(F.col("l.cid").alias("l"), F.col("r.cid").alias("r"))
    if not crowded.isEmpty():
        some = crowded.select("cid").distinct()
        items = classes.join(some, "cid").select("cid", F.explode("items").alias("item"), F.size("items").alias("n"))
        df = items.groupBy("item").count()
        ranked = items.join(df, "item").groupBy("cid", "n").agg(F.sort_array(F.collect_list(F.struct("count", "item"))).alias("x"))
        keep = f"cast(n - ceil({threshold!r} * n) + 1 as int)"
        front = ranked.select("cid", F.explode(F.expr(f"slice(x.item, 1, {keep})")).alias("item"))
        held = crowded.select("bucket", "cid", "n", "m").join(front, "cid")
        more = held.alias("l").join(held.alias("r"), F.expr(f"l.bucket = r.bucket and l.item = r.item and l.cid < r.cid and {close}"))
        pairs = pairs.unionByName(more.select(F.col("l.cid").alias("l"), F.col("r.cid").alias("r")))
    pairs = pairs.distinct()
    a, b = classes.select(F.col("cid").alias("l"), F.col("items").alias("x")), classes.select(F.col("cid").alias("r"), F.col("items").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    met = pairs.join(a, "l").join(b, "r").withColumn("both", both)
    jac = F.col("both") / (F.size("x") + F.size("y") - F.col("both"))
    return met.withColumn("jaccard", jac).filter(F.col("jaccard") >= threshold).select("l", "r", "jaccard")


def set_classes(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(classes, members) of records (``id``, ``items`` array<string>): equal sets are one class.

    classes: (``cid`` long, ``items`` array of longs); members: (``cid``, ``id``). Items are the
    64-bit hashes of the distinct non-null strings. Records with no item, or a null id, have no class;
    a record delivered twice with the same set is one member.
    """
    hashed = F.array_sort(F.array_distinct(F.transform(F.filter("items", lambda x: x.isNotNull()), lambda x: F.xxhash64(x))))
    rows = records.filter("id is not null").select("id", hashed.alias("items")).filter("size(items) > 0")
    grouped = rows.groupBy("items").agg(F.collect_set("id").alias("ids"))
    grouped = durable(grouped.withColumn("cid", F.monotonically_increasing_id()), "classes")
    return grouped.select("cid", "items"), grouped.select("cid", F.explode("ids").alias("id"))


def similar_sets(records: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per record in a similar pair: (``id``, ``cid``, ``links``), links being the number of other
    records whose sets reach ``threshold``. Copies are counted, not expanded."""
    classes, members = set_classes(records)
    size = members.groupBy("cid").agg(F.count("*").alias("n"))
    pairs = similar_classes(classes, threshold)
    both = pairs.selectExpr("l as cid", "r as other").unionByName(pairs.selectExpr("r as cid", "l as other"))
    far = both.join(size.selectExpr("cid as other", "n"), "other").groupBy("cid").agg(F.sum("n").alias("far"))
    links = members.join(size, "cid").join(far, "cid", "left").withColumn("links", F.col("n") - 1 + F.coalesce("far", F.lit(0)))
    return links.filter("links > 0").select("id", "cid", "links")


def similar_pairs(records: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """All pairs (``left``, ``right``, ``jaccard``) of records at or above ``threshold``, ``left < right``.

    Records are (``id``, ``items`` array<string>). Pairs between equal sets are there with 1.0; a
    record never pairs with itself, and a pair occurs once even if an id carries several sets (its
    best similarity stays). Nulls and empty sets pair with nothing; an empty table gives none.
    """
    classes, members = set_classes(records)
    pairs = similar_classes(classes, threshold)
    twins = members.groupBy("cid").agg(F.count("*").alias("n")).filter("n > 1").selectExpr("cid as l", "cid as r", "1.0D as jaccard")
    m = members.selectExpr("cid as l", "id as a"), members.selectExpr("cid as r", "id as b")
    met = pairs.unionByName(twins).join(m[0], "l").join(m[1], "r").filter("a <> b and (l <> r or a < b)")
    return met.groupBy(F.least("a", "b").alias("left"), F.greatest("a", "b").alias("right")).agg(F.max("jaccard").alias("jaccard"))


def profile_items(profiles: DataFrame, at_least: int = 4) -> DataFrame:
    """(``id``, ``items``): topics, organisation names and links of a profile, kept apart by a prefix, blanks left out."""

    def kept(col: Column, prefix: str) -> Column:
        x = F.filter(col, lambda v: v.isNotNull() & (v != ""))
        return F.coalesce(F.transform(x, lambda v: F.concat(F.lit(prefix), v)), F.array().cast("array<string>"))

    topics = F.transform("topics", lambda v: norm_text(v))
    orgs = F.transform("organizations", lambda o: norm_text(o["name"]))
    links = F.transform("outbound_links", lambda v: link_key(v))
    items = F.array_distinct(F.concat(kept(topics, "t:"), kept(orgs, "o:"), kept(links, "l:")))
    return profiles.select(F.col("profile_id").alias("id"), items.alias("items")).filter(F.size("items") >= at_least)
