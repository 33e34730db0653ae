"""Text cut off by field limits (problem 10).

Method: a backward character n-gram model compares, for the final context of every value, the end of
a text with its continuation. Contexts are the last 1 to 20 characters (lower case) and the last 1
to 6 tokens as shapes (small word, capitalised word, capitals, number, each mark, line break), read
from the end backwards; a longer context is shrunk towards the next shorter one. For a context

* ``a`` is the number of cut texts expected to end with it if texts are cut anywhere: its share of all
  positions inside of texts that go on, times the cut texts expected;
* ``b`` is the number of whole texts that end with it, the value itself left out, plus a share of
  ``LOOSE`` for places inside of texts where a mark that ends a sentence follows (the mark may be
  missing at the end of carelessly written texts);
* ``w`` is the share of its places inside of texts where the word ends there. Whole texts end with whole
  words, so a small ``w`` speaks for a cut however few texts end with this context.

The log-odds of cut against whole are thresholded at a prior for each column value's source and
length (in characters and in bytes), where piles at a field limit show, each language and each mark. Who is
whole enters ``b`` and the priors, so both are re-estimated ``ROUNDS`` times. Counts are taken over the whole
texts of all documents; only contexts that some text ends with are kept, which a Bloom filter of bounded size
sees to.

What a system writes behind a cut ("... more", "[...]") is learned: a closing that begins with a mark or a new
line is one of these marks if the texts before it end like cut texts behind many different words. It is
taken off, and the text before it is judged. An ellipsis is always taken off.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.durable import durable, release

LENGTHS = (1, 2, 3, 4, 5, 6, 8, 10, 13, 16, 20)
SHAPES = (1, 2, 3, 4, 6)
#: Characters from the end of a text that hold every context (a shape token is cut at 24 characters).
TAIL = 160
START_RATE, LOOSE, SHRINK, ROUNDS = 0.06, 0.1, 0.7, 3
#: A closing has at most so many characters; the odds before anything is known that it marks a cut, and the most that one word before it can say.
CLOSING, MARK_ODDS, WORD_SAYS = 24, 0.01, 4.0
#: A whole text ends inside of a word (a slip of the pen) in one of so many cases.
SLIP = 0.01
#: Rows that a prior of its own needs, in units of observations lent by the wider group.
LENT = 4.0
MAX_BLOOM_BITS = 1 << 28
CHUNK = 250_000
#: A miss costs more than a false alarm that a reader can check.
THRESHOLD = 0.15

_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xD6E8FEB86659FD93)
#: Marks that end a sentence.
_STOPS = np.array(sorted(map(ord, ".!?…:;)\"”»")), np.uint32)
_SMALL, _CAPITAL, _CAPITALS, _NUMBER, _BLANK, _LINE, _START = range(1, 8)


def _mix(h: np.ndarray, salt: int) -> np.ndarray:
    h = (h ^ np.uint64(salt)) * _Q
    h = (h ^ (h >> np.uint64(29))) * _P
    return h ^ (h >> np.uint64(32))


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts, each led by a 0, and the position of each 0."""
    joined = "\0" + "\0".join(t.replace("\0", " ") for t in texts)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    return codes, np.flatnonzero(codes == 0)


_TABLE: dict[str, np.ndarray] = {}


def _classes() -> np.ndarray:
    """Class of each code point below 0x3000: small letter, capital, digit, blank, line break, or the mark itself."""
    if "c" not in _TABLE:
        t = np.arange(0x3000, dtype=np.uint32) + 100
        for i in range(0x3000):
            c = chr(i)
            if c == "\n":
                t[i] = _LINE
            elif c.isspace():
                t[i] = _BLANK
            elif c.isdigit():
                t[i] = _NUMBER
            elif c.isalpha():
                t[i] = _CAPITAL if c.isupper() else _SMALL
        t[0] = _START
        _TABLE["c"] = t
    return _TABLE["c"]


def _lower(codes: np.ndarray) -> np.ndarray:
    if "l" not in _TABLE:
        t = np.arange(0x3000, dtype=np.uint32)
        for i in range(0x3000):
            x = chr(i).lower()
            if len(x) == 1:
                t[i] = ord(x)
        _TABLE["l"] = t
    out = codes.copy()
    m = codes < 0x3000
    out[m] = _TABLE["l"][codes[m]]
    return out


def _in_word(codes: np.ndarray) -> np.ndarray:
    kind = np.where(codes < 0x3000, _classes()[np.minimum(codes, 0x2FFF)], 0)
    return (kind == _SMALL) | (kind == _CAPITAL) | (kind == _NUMBER)


def context_hashes(codes: np.ndarray, at: np.ndarray, keep=None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, hashes) of every context kind that ends at one of the positions ``at``.

    ``keep`` says which hashes are wanted. A context is only wanted if the shorter ones at its end are, so
    positions drop out on the way and long contexts are computed for few of them. Without ``keep`` every kind
    has all positions, and a context that reaches over the start of its text has a hash that nothing else has.
    """
    n = len(codes)
    low = _lower(codes).astype(np.uint64)
    begins = np.maximum.accumulate(np.where(codes == 0, np.arange(n), 0))
    p, h = at, np.zeros(len(at), np.uint64)
    for k in range(1, max(LENGTHS) + 1):
        if keep is not None:  # characters up to and with the position
            m = p - begins[p] >= k
            p, h = p[m], h[m]
        h = (h * _P + low[np.maximum(p - k + 1, 0)] + np.uint64(1)) * _Q
        if k in LENGTHS:
            mixed = _mix(h, k)
            if keep is not None:
                m = keep(mixed)
                p, h, mixed = p[m], h[m], mixed[m]
            yield p, mixed
    table = _classes()
    kind = np.where(codes < 0x3000, table[np.minimum(codes, 0x2FFF)], codes + 100).astype(np.uint64)
    # Tokens: runs of letters, runs of digits, single marks. A blank belongs to no token unless it is the last character.
    letter = (kind == _SMALL) | (kind == _CAPITAL)
    group = np.where(letter, 1, np.where(kind == _NUMBER, 2, np.where(kind == _BLANK, 3, 0)))
    first = np.ones(n, bool)
    first[1:] = (group[1:] != group[:-1]) | (group[1:] == 0)
    starts_here = first & (group != 3)
    token_starts = np.flatnonzero(starts_here)
    capital_first = kind[token_starts] == _CAPITAL
    longer = kind[np.minimum(token_starts + 1, n - 1)] == _CAPITAL
    shape = np.where(group[token_starts] == 1, np.where(capital_first, np.where(longer, _CAPITALS, _CAPITAL), _SMALL), kind[token_starts]).astype(np.uint64)
    token = np.cumsum(starts_here) - 1  # the token a position is in or behind
    blank = (group == 3).astype(np.uint64)
    ht = np.zeros(len(token_starts), np.uint64)
    stopped = np.zeros(len(token_starts), bool)
    p = at
    for m in range(1, max(SHAPES) + 1):
        s = np.full(len(token_starts), np.uint64(_START))
        if m <= len(token_starts):
            s[m - 1 :] = shape[: len(token_starts) - m + 1]
        ht = np.where(stopped, ht, (ht * _P + s + np.uint64(1)) * _Q)
        stopped |= s == _START
        if m in SHAPES:
            mixed = _mix(ht[token[p]] * np.uint64(3) + blank[p], 100 + m)
            if keep is not None:
                k = keep(mixed)
                p, mixed = p[k], mixed[k]
            yield p, mixed


def _trimmed(text: str) -> str:
    """Without an ellipsis at the end, which may stand for what was cut."""
    t = text.rstrip("….") if text.endswith(("...", "…")) else text
    return t if t.strip() else text


def closings(text: str) -> list[str]:
    """Strings at the end of the text that may be a mark behind a cut: they begin with a mark (a run of equal ones counts as one) or a line break, blanks before them included."""
    tail, out = text.rstrip()[-CLOSING - 1 :], []
    for i in range(1, len(tail)):
        c, before = tail[i], tail[i - 1]
        if c.isalnum() or (c.isspace() and c != "\n") or c == before:
            continue
        j = i
        while j > 1 and tail[j - 1].isspace():
            j -= 1
        said = tail[j:]
        if len(said.strip()) > 1 and said.strip("….") and (tail[j - 1].isalnum() or j < i):
            out.append(said)
    return list(dict.fromkeys(out))


def _offered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        unit, said, word = [], [], []
        for u, t in zip(b.column("unit").to_pylist(), b.column("text").to_pylist()):
            for c in closings(t):
                head = t.rstrip()[-CLOSING - 60 :][: -len(c)]
                unit.append(u)
                said.append(c)
                word.append(head.rstrip().rsplit(None, 1)[-1] if head.strip() else "")
        yield pa.RecordBatch.from_arrays([pa.array(unit, pa.int64()), pa.array(said, pa.string()), pa.array(word, pa.string())], names=["unit", "closing", "word"])


def _without(text: str, closing: str | None) -> str:
    return _trimmed(text) if closing is None else _trimmed(text.rstrip()[: -len(closing)].rstrip()) or text


def _final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [_without(t, c)[-TAIL:] for t, c in zip(b.column("text").to_pylist(), b.column("closing").to_pylist())]
        if not texts:
            continue
        codes, at = _codes(texts)
        last = np.append(at[1:], len(codes)) - 1
        hashes = np.stack([h for _, h in context_hashes(codes, last)], 1)
        yield pa.RecordBatch.from_arrays(
            [
                b.column("unit"),
                b.column("closing"),
                pa.ListArray.from_arrays(pa.array(np.arange(0, hashes.size + 1, hashes.shape[1], dtype=np.int32)), pa.array(hashes.astype(np.uint64).view(np.int64).ravel())),
            ],
            names=["unit", "closing", "ctx"],
        )


def _counter(bloom: np.ndarray, bits: int):
    mask = np.uint64(bits - 1)

    def hit(h: np.ndarray) -> np.ndarray:
        i, j = h & mask, (h >> np.uint64(24)) & mask
        one = np.uint8(1)
        return ((bloom[i >> np.uint64(3)] >> (i & np.uint64(7)).astype(np.uint8)) & (bloom[j >> np.uint64(3)] >> (j & np.uint64(7)).astype(np.uint8)) & one).astype(bool)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column("text").to_pylist()
            i = 0
            while i < len(column):  # so many characters at once that the arrays stay small
                take, size = [], 0
                while i < len(column) and (not take or size + len(column[i]) < CHUNK):
                    take.append(_trimmed(column[i]))
                    size += len(take[-1])
                    i += 1
                codes, _ = _codes(take)
                after = np.append(codes[1:], 0)
                inner = (codes != 0) & (after != 0)
                stop = np.isin(after, _STOPS) & inner
                word = _in_word(codes)
                run = word & np.append(word[1:], False)
                hs, ss, rs = [], [], []
                for at, h in context_hashes(codes, np.flatnonzero(inner), hit):
                    hs.append(h)
                    ss.append(stop[at])
                    rs.append(run[at])
                h, s = np.concatenate(hs), np.concatenate(ss)
                inv, u = pd.factorize(h)  # by hashing; sorting would cost most of the pass
                stops = np.bincount(inv, s, len(u))
                runs = np.append(np.bincount(inv, np.concatenate(rs), len(u)), [run.sum(), word.sum()])
                every = np.bincount(inv, minlength=len(u))
                u = np.append(u.view(np.int64), [0, 1])  # rows 0 and 1 carry the totals
                goes, stops = np.append(every - stops, [inner.sum() - stop.sum(), 0]), np.append(stops, [0, stop.sum()])
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(goes.astype(np.float64)), pa.array(stops.astype(np.float64)), pa.array(runs.astype(np.float64))], names=["h", "goes", "stops", "runs"])

    return count


def _bloom_words(bits: int):
    mask = np.uint64(bits - 1)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = b.column("ctx").flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            i = np.unique(np.concatenate([h & mask, (h >> np.uint64(24)) & mask]))
            w = (i >> np.uint64(6)).astype(np.int64)
            u, inv = np.unique(w, return_inverse=True)
            v = np.zeros(len(u), np.uint64)
            np.bitwise_or.at(v, inv, np.uint64(1) << (i & np.uint64(63)))
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v.view(np.int64))], names=["w", "v"])

    return words


def _chain(n_units: float, inner_goes: float, inner_stops: float, in_word: float, rate: float):
    kinds = len(LENGTHS)

    @F.pandas_udf("evidence double, inside double")
    def odds(k: pd.Series, goes: pd.Series, stops: pd.Series, runs: pd.Series, ends: pd.Series, own: pd.Series) -> pd.DataFrame:
        if not len(k):
            return pd.DataFrame({"evidence": [], "inside": []}, dtype=float)
        order = np.argsort(np.stack(k.to_numpy()), 1)  # every row has each kind once
        g, s, r, e = (np.take_along_axis(np.stack(x.to_numpy()), order, 1) for x in (goes, stops, runs, ends))
        e = np.maximum(0, e)
        a = rate * n_units * g / inner_goes
        b = e + LOOSE * n_units * s / max(1.0, inner_stops)
        total = np.zeros(len(k))
        for part in (range(kinds), range(kinds, g.shape[1])):
            q = np.full(len(k), 1 - rate)
            for i in part:
                q = (b[:, i] + SHRINK * q) / (a[:, i] + b[:, i] + SHRINK)
            total += np.log(np.maximum(1e-9, 1 - q) / np.maximum(1e-9, q)) - math.log(rate / (1 - rate))
        w, mine = np.full(len(k), 1 - in_word), own.to_numpy(float)  # before a closing the context stands inside of its own text
        for i in range(kinds):
            places = np.maximum(r[:, i], g[:, i] + s[:, i] - mine) + e[:, i]
            w = (places - r[:, i] + w) / (places + 1)
        inside = np.log((1 - in_word) / (np.clip(w, 0, 1) * (1 - SLIP) + SLIP))
        return pd.DataFrame({"evidence": total + np.maximum(0, inside), "inside": inside})  # without the prior

    return odds


def _by_context(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Join on ``h``. Contexts that a thousandth of all rows end with (``hot``; at most 1000 for each kind of context) are broadcast, the others shuffled."""
    hot = rows.filter("hot").drop("hot").join(F.broadcast(table.join(F.broadcast(rows.filter("hot").select("h").distinct()), "h", "left_semi")), "h")
    return hot.unionByName(rows.filter("not hot").drop("hot").join(table, "h"))


def _marks(scored: DataFrame) -> DataFrame:
    """Closings that mark a cut: the texts before them end inside of words, behind many different ones."""
    says = F.greatest(F.lit(-WORD_SAYS), F.least(F.lit(WORD_SAYS), F.avg("inside")))
    words = scored.filter("closing is not null").groupBy("closing", "word").agg(says.alias("says"))
    return words.groupBy("closing").agg(F.sum("says").alias("says")).filter(F.col("says") + math.log(MARK_ODDS / (1 - MARK_ODDS)) > 0).select("closing")


def cut_scores(docs: DataFrame) -> DataFrame:
    """Each document with its posterior: (``doc_id``, ``source``, ``lang``, ``p_cut``).

    A null text isn't cut and not in the result; an empty or blank one gets 0. Equal texts of one
    source are scored once and leave themselves out of their own evidence, so repeats don't vouch for
    each other. A null source or language is a value of its own. An empty table gives an empty result.
    """
    rows = docs.filter("text is not null").select("doc_id", "text", F.coalesce("source", F.lit("?")).alias("source"), F.coalesce("lang", F.lit("?")).alias("lang"))
    keyed = rows.withColumn("unit", F.xxhash64("text", "source"))
    plain = keyed.select("doc_id", "source", "lang", "unit", F.length("text").alias("n"), F.octet_length("text").alias("bytes"))
    units = keyed.filter("trim(text) <> ''").select("unit", F.substring("text", -TAIL - CLOSING, TAIL + CLOSING).alias("text"))
    offered = durable(units.mapInArrow(_offered, "unit long, closing string, word string").distinct(), "closings")
    usual = offered.groupBy("closing").agg(F.min("word").alias("a"), F.max("word").alias("b")).filter("a <> b").select("closing")
    probes = offered.join(usual, "closing")
    tails = units.select("unit", "text").withColumn("closing", F.lit(None).cast("string")).unionByName(units.join(probes, "unit").select("unit", "text", "closing"))
    final = tails.mapInArrow(_final, "unit long, closing string, ctx array<long>").groupBy("unit", "closing").agg(F.first("ctx").alias("ctx"))
    final = durable(final.withColumn("row", F.xxhash64("unit", "closing")), "final")
    n_rows, n_units = (int(x or 0) for x in final.agg(F.count("*"), F.sum(F.col("closing").isNull().cast("long"))).first())
    if not n_units:
        release(offered, final)
        return plain.select("doc_id", "source", "lang", F.lit(0.0).alias("p_cut"))
    bits = min(MAX_BLOOM_BITS, 1 << max(16, math.ceil(math.log2(16 * n_rows * (len(LENGTHS) + len(SHAPES))))))
    words = final.select("ctx").mapInArrow(_bloom_words(bits), "w long, v long").groupBy("w").agg(F.bit_or("v").alias("v")).toArrow()  # at most bits / 64 rows
    bloom = np.zeros(bits // 64, np.uint64)
    bloom[words.column("w").to_numpy()] = words.column("v").to_numpy().view(np.uint64)
    counts = rows.select("text").mapInArrow(_counter(bloom.view(np.uint8), bits), "h long, goes double, stops double, runs double").groupBy("h")
    counts = durable(counts.agg(F.sum("goes").alias("goes"), F.sum("stops").alias("stops"), F.sum("runs").alias("runs")), "counts")
    total = {r["h"]: r for r in counts.filter("h in (0, 1)").collect()}
    inner_goes, inner_stops = max(1.0, total[0]["goes"]), total[1]["stops"]
    in_word = total[0]["runs"] / max(1.0, total[1]["runs"])
    single = final.select("row", F.posexplode("ctx").alias("k", "h"))
    often = single.groupBy("h").count().filter(F.col("count") * 1000 >= n_rows).select("h", F.lit(True).alias("hot"))  # at most 1000 for each kind
    single = single.join(F.broadcast(often), "h", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    every = single.select("h", "hot").distinct().join(counts, "h", "left").select("h", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("goes", "stops", "runs")])
    ctx = durable(_by_context(single, every).join(final.select("row", "unit", "closing"), "row").join(F.broadcast(often), "h", "left").withColumn("hot", F.coalesce("hot", F.lit(False))), "contexts")
    about = durable(plain.groupBy("unit").agg(*[F.first(c).alias(c) for c in ("source", "lang", "n", "bytes")]), "units")
    weights, rate, old = None, START_RATE, []
    for turn in range(ROUNDS):
        if weights is None:
            c = ctx.withColumn("w", F.when(F.col("closing").isNull(), 1 - START_RATE).otherwise(0.0))
        else:
            c = ctx.join(weights.select("row", F.col("whole").alias("w")), "row")
        ends = c.groupBy("h").agg(F.sum("w").alias("ends"))
        c = _by_context(c, ends).groupBy("row").agg(
            F.first("unit").alias("unit"), F.first("closing").alias("closing"), *[F.collect_list(x).alias(x) for x in ("k", "goes", "stops", "runs")], F.collect_list(F.col("ends") - F.col("w")).alias("ends")
        )
        odds = _chain(float(n_units), inner_goes, inner_stops, in_word, rate)("k", "goes", "stops", "runs", "ends", F.col("closing").isNotNull().cast("double"))
        scored = durable(c.select("row", "unit", "closing", odds.alias("o")).select("row", "unit", "closing", "o.*"), "scored")
        if turn == 0:  # which mark a text carries, if any, is settled here
            marks = _marks(scored.join(probes, ["unit", "closing"]))
            marked = scored.filter("closing is not null").join(marks, "closing", "left_semi").groupBy("unit").agg(F.max_by("closing", F.length("closing")).alias("mark"))
            chosen = durable(scored.join(marked, "unit", "left").filter(F.col("closing").eqNullSafe(F.col("mark"))).drop("mark"), "chosen")
            release(scored)
            scored = chosen
        cut_off = F.length(F.coalesce("closing", F.lit("")))
        base = scored.join(about, "unit").withColumn("n", F.col("n") - cut_off).withColumn("bytes", F.col("bytes") - F.octet_length(F.coalesce("closing", F.lit(""))))
        # Priors: the rate of the source at this very length, lent from the source, and of the language and the mark, all from evidence at the common prior.
        base = base.withColumn("mark", F.coalesce("closing", F.lit(""))).withColumn("p", 1 / (1 + F.exp(-(F.col("evidence") + math.log(rate / (1 - rate))))))
        all_ = base.agg(F.avg("p")).first()[0]
        share = lambda lent: ((F.sum("p") + lent * all_) / (F.count("*") + lent))
        logit = lambda x: F.log(x / (1 - x))
        safe = lambda x: F.greatest(F.lit(1e-4), F.least(F.lit(1 - 1e-4), x))
        above = lambda x: logit(safe(x)) - logit(safe(F.lit(all_)))
        prior = base.join(base.groupBy("source").agg(share(LENT).alias("ps")), "source").join(base.groupBy("lang").agg(share(10 * LENT).alias("pl")), "lang")
        prior = prior.join(base.groupBy("mark").agg(share(LENT).alias("pm")), "mark")
        own = []
        for unit in ("n", "bytes"):
            hits, cases = f"hits_{unit}", f"cases_{unit}"
            prior = prior.join(base.groupBy("source", unit).agg(F.sum("p").alias(hits), F.count("*").alias(cases)), ["source", unit])
            own.append((F.col(hits) - F.col("p") + LENT * F.col("ps")) / (F.col(cases) - 1 + LENT))
        z = F.col("evidence") + logit(safe(F.greatest(*own))) + above(F.col("pl")) + above(F.col("pm"))
        weights = durable(prior.select("row", "unit", (1 - 1 / (1 + F.exp(-z))).alias("whole")), "weights")
        rate = min(0.5, max(1e-3, weights.agg(F.avg(1 - F.col("whole"))).first()[0]))
        release(*old)
        old = [scored, weights]
    release(offered, final, counts, ctx, about, scored)
    return plain.join(weights.select("unit", "whole"), "unit", "left").select("doc_id", "source", "lang", (1 - F.coalesce("whole", F.lit(1.0))).alias("p_cut"))


def cut_documents(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(``doc_id``) of the documents whose text is only the beginning of what was sent."""
    return cut_scores(docs).filter(F.col("p_cut") > threshold).select("doc_id")


def cut_rates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """For each ``source``: ``n_docs``, ``n_cut`` and ``rate``."""
    hit = (F.col("p_cut") > threshold).cast("long")
    return cut_scores(docs).groupBy("source").agg(F.count("*").alias("n_docs"), F.sum(hit).alias("n_cut"), F.avg(hit).alias("rate"))
