"""Weighted character n-gram vectors of names and the sparse cosine join between them (problems 1 and 5).

A name is a given name, its other forms, and a surname. Under every initial that its given name may
have it is one vector: trigrams of the surname, and trigrams of those forms of the given name that have this
initial, both weighted by inverse document frequency, of unit length, and brought together in the shares
``SURNAME`` and the rest. Grams are hashed to ``BUCKETS`` dimensions, so the table of their frequencies has a fixed size. A name with a bare initial is its surname alone. Order of the parts and titles are
gone before, so they don't count.

The join finds all pairs of vectors with a cosine of at least the threshold. Grams are ordered from rare to common; only the
prefix of a vector whose rest is still as long as the threshold is joined, and two vectors that meet in a gram
stay a candidate only if what follows in both can still reach the threshold (the first gram they have in common
always passes this) and if their marks, a bit for every gram, agree in enough places. Grams in common number no more than bits in
common and collisions. None adds more than the product of the largest weights, and by Cauchy and Schwarz the heaviest so many grams of
one of the two must hold as much of its length as the threshold. Nothing is cut to the best n: a cap would lose partners of names that many records have.

Pairs grow as the square of the records, so they are made in slices (:func:`pair_slices`), of which each takes disk in proportion to
the records: a record has one of ``SLOTS`` slots by its id's hash, and a slice has the pairs whose smaller slot is one of its own.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.durable import durable, gathered, release

COSINE, SURNAME, GRAM = 0.45, 0.7, 3
BUCKETS = 1 << 20
#: Letters of a surname that is also compared without one of them.
LONGEST = 64
#: Words of 64 bits in a mark.
MARKS = 4
#: Records of one key that meet in one task, on either side; the pairs of a key with more are spread over several.
KEY_BLOCK = 512
#: Slots that records are dealt to, the most slices there can be.
SLOTS = 4096
#: Pairs of records with a gram in common (counted for each gram) that a slice has for each name of a record.
MEETS = 500
#: Pairs of vectors for each vector that are weighed at once, as each takes a vector along.
WEIGHED = 2


def blocked_join(left: DataFrame, right: DataFrame, on: Column | None = None) -> DataFrame:
    """Pairs of rows (``key``, ``l``, other columns) and (``key``, ``r``, other columns) with one key, where ``on`` holds.

    A key is joined in blocks of ``KEY_BLOCK`` rows of each side, so that none is one task's, however many rows have it.
    Null keys meet nothing.
    """
    sizes = left.groupBy("key").agg(F.count("*").alias("na")).join(right.groupBy("key").agg(F.count("*").alias("nb")), "key")
    big = sizes.filter(f"na > {KEY_BLOCK} or nb > {KEY_BLOCK}").select("key", *[F.ceil(F.col(n) / KEY_BLOCK).cast("int").alias(x) for n, x in (("na", "ba"), ("nb", "bb"))])
    big = durable(big, "big_keys")

    def spread(k: DataFrame, name: str, mine: str, others: str) -> DataFrame:
        k = k.join(big, "key", "left").withColumn(mine, F.coalesce(F.pmod(F.xxhash64(name), F.col(mine)).cast("int"), F.lit(0)))
        return k.withColumn(others, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(others), F.lit(1)) - 1)))

    met = spread(left, "l", "ba", "bb").join(spread(right, "r", "bb", "ba"), ["key", "ba", "bb"])
    return (met if on is None else met.filter(on)).drop("ba", "bb")


def name_entries(feats: DataFrame) -> DataFrame:
    """(``entry``, ``i``, ``alts``, ``s``, ``id``, ``side``): the names of each record under each initial."""
    n = feats.select("id", "side", F.explode("names").alias("n")).select("id", "side", F.col("n.g").alias("g"), F.col("n.alts").alias("alts"), F.col("n.s").alias("s"))
    n = n.withColumn("i", F.explode(F.array_distinct(F.transform("alts", lambda a: F.substring(a, 1, 1)))))
    alts = F.filter("alts", lambda a: a.startswith(F.col("i")) & (F.length(a) > 1))
    return n.select(F.xxhash64("i", "g", "s").alias("entry"), "i", alts.alias("alts"), "s", "id", "side").distinct()


def _slot(c: str) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(SLOTS)).cast("short")


def _grams(initial: str, kind: str, words, memo: dict[str, int]) -> list[int]:
    """Distinct buckets of the trigrams of the words."""
    out = {}
    for word in words:
        padded = f"^{word}$"
        for k in range(max(1, len(padded) - GRAM + 1)):
            g = initial + kind + padded[k : k + GRAM]
            at = memo.get(g)
            if at is None:
                at = zlib.crc32(g.encode()) % BUCKETS
                if len(memo) < 500_000:
                    memo[g] = at
            out[at] = None
    return list(out)


def _ints(rows: list[list[int]]) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.cumsum([0, *map(len, rows)], dtype=np.int32), np.fromiter((x for r in rows for x in r), np.int32))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memo: dict[str, int] = {}
    for b in batches:
        initial, alts, surname = (b.column(c).to_pylist() for c in ("i", "alts", "s"))
        sur = [_grams(i, "s", [s], memo) for i, s in zip(initial, surname)]
        given = [[g for g in _grams(i, "g", a, memo) if g not in s] if a else [] for i, a, s in zip(initial, alts, sur)]
        yield pa.RecordBatch.from_arrays([b.column("entry"), b.column("slots"), b.column("held"), _ints(sur), _ints(given)], names=["entry", "slots", "held", "sur", "given"])


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df = np.zeros(BUCKETS, np.int64)
    for b in batches:
        for c in ("sur", "given"):
            df += np.bincount(b.column(c).flatten().to_numpy(), minlength=BUCKETS)
    some = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(df[some])], names=["gram", "df"])


def _vectorizer(df: np.ndarray, n: int, surname: float, cosine: float):
    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf = np.log((n + 1) / np.maximum(1, df)) + 0.1
        for b in batches:
            k = b.num_rows
            if not k:
                continue
            sizes = [np.diff(b.column(c).offsets.to_numpy()) for c in ("sur", "given")]
            grams = [b.column(c).flatten().to_numpy() for c in ("sur", "given")]
            rows = [np.repeat(np.arange(k), z) for z in sizes]
            norm = [np.sqrt(np.bincount(r, idf[g] ** 2, k)) for r, g in zip(rows, grams)]
            share = np.where(sizes[1] > 0, surname**0.5, 1.0)
            w = np.concatenate([idf[grams[0]] * (share / norm[0])[rows[0]], idf[grams[1]] * ((1 - surname) ** 0.5 / np.maximum(norm[1], 1e-12))[rows[1]]])
            gram, row = np.concatenate(grams), np.concatenate(rows)
            order = np.lexsort((gram, df[gram], row))
            gram, row, w = gram[order], row[order], w[order]
            ends = np.cumsum(sizes[0] + sizes[1])
            starts = ends - sizes[0] - sizes[1]
            before = np.concatenate([[0.0], np.cumsum(w * w)])
            rest = np.sqrt(np.maximum(0.0, before[ends][row] - before[:-1]))
            heavy = np.lexsort((-w, row))
            held = np.concatenate([[0.0], np.cumsum(w[heavy] ** 2)])
            held = held[1:] - held[starts][row]
            need = np.bincount(row, held < cosine - 1e-9, k).astype(np.int32) + 1
            bit = np.left_shift(np.uint64(1), (gram & 63).astype(np.uint64))
            marks = [np.bitwise_or.reduceat(np.where((gram >> 6) % MARKS == m, bit, np.uint64(0)), starts).view(np.int64) for m in range(MARKS)]
            offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (gram.astype(np.int32), w, rest)]
            yield pa.RecordBatch.from_arrays([b.column("entry"), b.column("slots"), b.column("held"), *lists, pa.array(np.maximum.reduceat(w, starts)), pa.array(need), *map(pa.array, marks)], names=["entry", "slots", "held", "grams", "w", "rest", "top", "need", *[f"m{m}" for m in range(MARKS)]])

    return vectors


def name_vectors(entries: DataFrame, surname: float = SURNAME, cosine: float = COSINE) -> DataFrame:
    """(``entry``, ``slots``, ``held``, ``grams``, ``w``, ``rest``, ``top``, ``need``, marks) of distinct entries: slots and number of the records
    that have it, grams from rare to common, their weights in the unit vector, the length of the vector from each gram on, the largest weight, and how many grams at least sum to ``cosine``. Ties in rarity are ordered by the gram."""
    e = entries.groupBy("entry").agg(*[F.first(c).alias(c) for c in ("i", "alts", "s")], F.collect_set(_slot("id")).alias("slots"), F.count("*").alias("held"))
    e = durable(e.mapInArrow(_hashed, "entry long, slots array<short>, held long, sur array<int>, given array<int>"), "hashed")
    counted = durable(e.select("sur", "given").mapInArrow(_frequencies, "gram int, df long").groupBy("gram").agg(F.sum("df").alias("df")), "frequencies")
    table = counted.toArrow()  # at most BUCKETS rows
    df = np.zeros(BUCKETS, np.int64)
    df[table.column("gram").to_numpy()] = table.column("df").to_numpy()
    schema = "entry long, slots array<short>, held long, grams array<int>, w array<double>, rest array<double>, top double, need int, " + ", ".join(f"m{k} long" for k in range(MARKS))
    out = durable(e.mapInArrow(_vectorizer(df, max(1, e.count()), surname, cosine), schema), "vectors")
    release(e, counted)
    return out


def cosine_join(left: DataFrame, right: DataFrame, cosine: float = COSINE, weighed: int = 1 << 20) -> DataFrame:
    """All pairs (``a``, ``b``, ``cosine``) of vectors of ``left`` and ``right`` at or above ``cosine``. A vector of ``right`` that is
    ``also`` one of ``left`` meets only smaller entries, so that no pair comes twice. ``weighed``: candidates whose cosine is taken at once."""
    marks = [f"m{i}" for i in range(MARKS)]
    spare = F.size("grams") - sum(F.bit_count(m) for m in marks)  # grams that share their bit with another one
    carried = ["w", "q", "top", "need", "spare", *marks]

    def side(vectors: DataFrame, name: str, *more: str) -> DataFrame:
        front = vectors.select("entry", *more, "top", "need", spare.alias("spare"), *marks, F.explode(F.arrays_zip("grams", "w", "rest")).alias("z")).filter(F.col("z.rest") >= cosine - 1e-9)
        front = front.select("entry", *more, "top", F.col("need").cast("short"), F.col("spare").cast("short"), *marks, F.col("z.grams").alias("key"), F.col("z.w").alias("w"), (F.col("z.rest") * F.col("z.rest") - F.col("z.w") * F.col("z.w")).alias("q"))
        front = front.withColumns({c: F.col(c).cast("float") for c in ("w", "q", "top")})  # bounds only, so single precision will do
        return front.select("key", F.col("entry").alias(name), *more, *[F.col(c).alias(c + name) for c in carried])

    reach = F.col("wl") * F.col("wr") + F.sqrt(F.greatest(F.lit(0.0), F.col("ql")) * F.greatest(F.lit(0.0), F.col("qr"))) >= cosine - 1e-5
    common = sum(F.bit_count(F.col(m + "l").bitwiseAND(F.col(m + "r"))) for m in marks) + F.least("sparel", "sparer")
    reach = reach & (common * F.col("topl") * F.col("topr") >= cosine - 1e-5) & (common >= F.least("needl", "needr"))
    met = blocked_join(side(left, "l"), side(right, "r", "also"), reach & F.expr("l < r or not also")).select("l", "r").distinct()
    met = durable(met, "met")
    packed = lambda vectors, name: vectors.select(F.col("entry").alias(name), F.map_from_arrays("grams", "w").alias("m" + name))
    dot = F.aggregate(F.map_entries("ml"), F.lit(0.0), lambda acc, x: acc + x["value"] * F.coalesce(F.element_at("mr", x["key"]), F.lit(0.0)))
    parts, near = max(1, math.ceil(met.count() / weighed)), []
    for k in range(parts):
        mine = lambda df, c: df.filter(F.pmod(F.xxhash64(c), F.lit(parts)) == k)  # noqa: B023, E731
        both = mine(met, "l").join(packed(mine(left, "entry"), "l"), "l").join(packed(right, "r"), "r")
        near.append(durable(both.select(F.col("l").alias("a"), F.col("r").alias("b"), dot.alias("cosine")).filter(F.col("cosine") >= cosine - 1e-9), "near"))
    release(met)
    return gathered(near)


def _records(near: DataFrame, mine: DataFrame, other: DataFrame, *more: str) -> tuple[DataFrame, DataFrame]:
    """Keys of both sides from pairs of entries (``a``, ``b``, ``cosine``) and who holds them. ``more``: columns of ``other``."""
    lk = near.select(F.xxhash64("a", "b").alias("key"), F.col("a").alias("entry"), "cosine").join(mine.select("entry", F.col("id").alias("l")), "entry").select("key", "l", "cosine")
    rk = near.select(F.xxhash64("a", "b").alias("key"), F.col("b").alias("entry")).join(other.select("entry", F.col("id").alias("r"), *more), "entry").select("key", "r", *more)
    return lk, rk


def slot_bounds(vectors: DataFrame, cosine: float = COSINE) -> list[int]:
    """Ends of the slices: the slots of each have about as many pairs with equal and later slots, ``MEETS`` for each name or fewer."""
    front = vectors.select("held", F.explode(F.arrays_zip("grams", "rest")).alias("z")).filter(F.col("z.rest") >= cosine - 1e-9)
    n = front.groupBy("z.grams").agg(F.sum("held").cast("double").alias("n")).agg(F.sum(F.col("n") * F.col("n") / 2)).first()[0]
    names = vectors.agg(F.sum("held")).first()[0]
    k = min(SLOTS, math.ceil(n / (MEETS * names))) if n else 1
    return sorted({round(SLOTS * (1 - (1 - i / k) ** 0.5)) for i in range(k + 1)})


def pair_slices(feats: DataFrame, cosine: float = COSINE) -> Iterator[tuple[DataFrame, DataFrame, DataFrame]]:
    """Slices of the pairs of records (``l``, ``r``) of one table with names at or above ``cosine``, and that ``cosine``; each pair is in one
    slice, in either order. Beside each slice the features that its ``l`` and its ``r`` can have. A slice is gone when the next is asked for."""
    held = durable(name_entries(feats), "entries")
    vectors = name_vectors(held, cosine=cosine)
    bounds, weighed = slot_bounds(vectors, cosine), max(1, WEIGHED * vectors.count())
    for start, end in zip(bounds, bounds[1:]):
        mine = F.exists("slots", lambda s: (s >= start) & (s < end))  # noqa: B023
        near = cosine_join(vectors.filter(mine), vectors.filter(F.array_max("slots") >= start).withColumn("also", mine), cosine, weighed)
        within = lambda df: df.filter((_slot("id") >= start) & (_slot("id") < end))  # noqa: B023, E731
        left, right = within(held), held.filter(_slot("id") >= start).withColumn("later", _slot("id") >= end)
        either = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"), "cosine"))
        lk, rk = _records(either, left, right, "later")
        # one and the same name
        lk = lk.unionByName(left.select(F.col("entry").alias("key"), F.col("id").alias("l"), F.lit(1.0).alias("cosine")))
        rk = rk.unionByName(right.select(F.col("entry").alias("key"), F.col("id").alias("r"), "later"))
        pairs = blocked_join(lk, rk, F.expr("later or l < r")).groupBy("l", "r").agg(F.max("cosine").alias("cosine"))
        yield pairs, within(feats), feats.filter(_slot("id") >= start)
        release(near)
    release(vectors, held)


def name_pairs(feats: DataFrame, same: bool, cosine: float = COSINE) -> DataFrame:
    """Pairs of records (``l``, ``r``) with names at or above ``cosine``, and that ``cosine``: within one table (``same``,
    ``l < r``) or from side 0 to side 1. A record without a name is in no pair."""
    if same:
        parts = [durable(pairs.select(F.least("l", "r").alias("l"), F.greatest("l", "r").alias("r"), "cosine"), "pairs") for pairs, _, _ in pair_slices(feats, cosine)]
        return gathered(parts)
    held = durable(name_entries(feats), "entries")
    vectors = name_vectors(held, cosine=cosine)
    on = lambda k: held.filter(F.col("side") == k)
    of = lambda k: vectors.join(on(k).select("entry").distinct(), "entry", "left_semi")
    near = cosine_join(of(0), of(1).withColumn("also", F.lit(False)), cosine)
    release(vectors)
    return blocked_join(*_records(near, on(0), on(1))).groupBy("l", "r").agg(F.max("cosine").alias("cosine"))


def edit_pairs(feats: DataFrame, most: int = 3) -> DataFrame:
    """Pairs of records (``l`` of side 0, ``r`` of side 1) with an initial in common and surnames at most ``most`` edits apart.

    Surnames meet on what is left without one letter (so none at one edit or one swap of neighbours is missed, up to
    ``LONGEST`` letters) and on their first and last five letters; the distance is tested where they meet.
    """
    held = durable(name_entries(feats), "entries")
    e = held.groupBy("entry").agg(F.first("i").alias("i"), F.first("s").alias("s"), F.max(F.col("side") == 0).alias("on0"), F.max(F.col("side") == 1).alias("on1"))
    n = F.length("s")
    less = F.transform(F.sequence(F.lit(1), n), lambda k: F.concat(F.substring("s", F.lit(1), k - 1), F.substring("s", k + 1, n)))
    less = F.when(n <= LONGEST, F.concat(F.array("s"), less)).otherwise(F.array("s"))
    keys = F.concat(F.transform(less, lambda x: F.xxhash64("i", F.lit("-"), x)), F.array(F.xxhash64("i", F.lit("<"), F.substring("s", 1, 5)), F.xxhash64("i", F.lit(">"), F.expr("right(s, 5)"))))
    front = e.select("entry", "s", "on0", "on1", F.explode(F.array_distinct(keys)).alias("key"))
    side = lambda on, name: front.filter(on).select("key", F.col("entry").alias(name), F.col("s").alias("s" + name))
    met = blocked_join(side("on0", "l"), side("on1", "r"), F.levenshtein("sl", "sr", most) >= 0)
    near = durable(met.select(F.col("l").alias("a"), F.col("r").alias("b"), F.lit(1.0).alias("cosine")).distinct(), "near")
    on = lambda k: held.filter(F.col("side") == k)
    return blocked_join(*_records(near, on(0), on(1))).select("l", "r").distinct()
