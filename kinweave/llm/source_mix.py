"""Mixing sources to target weights (problem 9).

Method: soft-membership mixing. A classifier fitted on the labelled table (token counts by source, all
documents, smoothed; the temperature is chosen by log loss) gives each document a posterior over the
sources. Nonnegative document rates, at most the source's repeats, are fitted by projected gradient
least squares, so that the expected tokens of each domain match the targets: once with the posterior as
membership and, where a document states its source, once with that. The gradient of a document depends
on its own tokens and memberships and on one residual per domain, so an iteration is one aggregate of a
dozen sums; a document's rate is replayed from the residuals of all iterations, nothing per document
goes to the driver. Rates then become whole repeats: a threshold per source, found by bisection over
all documents, makes the tokens of each source meet its target.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.durable import durable
from kinweave.llm.tokens import VOCABULARY, measured

VOCAB = 50_257
ITERATIONS, USED, SOFT = 30, 0.98, 0.3
TEMPERATURES = (0.05, 0.1, 0.2, 0.35, 0.6, 1.0)


def _lists(col: pa.ChunkedArray | pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    off = col.offsets.to_numpy()
    return col.values.to_numpy(zero_copy_only=False)[off[0] : off[-1]], np.diff(off)


def _count(k: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((k, VOCAB))
        for b in batches:
            flat, sizes = _lists(b.column("ids"))
            src = np.repeat(b.column("k").to_numpy(zero_copy_only=False), sizes)
            ok = src >= 0
            table += np.bincount(src[ok].astype(np.int64) * VOCAB + flat[ok], minlength=k * VOCAB).reshape(k, VOCAB)
        s, t = np.nonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(s.astype(np.int32)), pa.array(t.astype(np.int32)), pa.array(table[s, t])], names=["k", "t", "n"])

    return count


def _scores(logp: np.ndarray, prior: np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    doc = np.repeat(np.arange(len(sizes)), sizes)
    z = np.stack([np.bincount(doc, w[flat], len(sizes)) for w in logp], 1)
    return z + prior


def _soft(z: np.ndarray, temperature: float) -> np.ndarray:
    z = z * temperature
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def _losses(logp, prior):
    def losses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(TEMPERATURES))
        for b in batches:
            flat, sizes = _lists(b.column("ids"))
            k = b.column("k").to_numpy(zero_copy_only=False)
            z, ok = _scores(logp, prior, flat, sizes), k >= 0
            for i, t in enumerate(TEMPERATURES):
                p = _soft(z, t)[np.flatnonzero(ok), k[ok].astype(int)]
                total[i] -= np.log(np.maximum(p, 1e-12)).sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["i", "loss"])

    return losses


def _posterior(logp, prior, temperature):
    def posterior(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, sizes = _lists(b.column("ids"))
            p = _soft(_scores(logp, prior, flat, sizes), temperature)
            cols = [b.column(c) for c in ("doc_id", "source", "k", "n_tokens")]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, p.size + 1, p.shape[1], dtype=np.int32)), pa.array(p.ravel()))
            yield pa.RecordBatch.from_arrays([*cols, lists], names=["doc_id", "source", "k", "n_tokens", "p"])

    return posterior


def _memberships(pdf: pd.DataFrame, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, memberships: soft columns times SOFT beside stated columns, source index)."""
    t = pdf["n_tokens"].to_numpy(float)
    soft = np.stack(pdf["p"].to_numpy()) if len(pdf) else np.zeros((0, k))
    src = pdf["k"].to_numpy(int)
    stated = np.zeros((len(pdf), k))
    stated[np.flatnonzero(src >= 0), src[src >= 0]] = 1.0
    return t, np.concatenate([SOFT * soft, stated], 1), src


def _rates(t, m, src, cap, start, residuals: list[np.ndarray], scale: float) -> np.ndarray:
    """The point of each document at which the next residual is taken: its rate after the accelerated projected
    gradient steps that ``residuals`` say, ahead by the momentum. Long and short texts move alike: a step is per token."""
    top = np.where(src >= 0, cap[src], 0.0)
    r = y = np.minimum(top, np.where(src >= 0, start[src], 0.0))
    for i, res in enumerate(residuals):
        new = np.clip(y - scale * (m @ res), 0.0, top)
        y = np.clip(new + i / (i + 3) * (new - r), 0.0, top)
        r = new
    return y


def _curvature(k: int):
    def curvature(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = np.zeros((2 * k, 2 * k))
        for pdf in batches:
            t, m, _ = _memberships(pdf, k)
            c += (m * t[:, None]).T @ m
        yield pd.DataFrame({"i": np.arange(c.size, dtype=np.int32), "v": c.ravel()})

    return curvature


def _totals(k, cap, start, residuals, scale):
    def totals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = np.zeros(2 * k)
        for pdf in batches:
            t, m, src = _memberships(pdf, k)
            s += (_rates(t, m, src, cap, start, residuals, scale) * t) @ m
        yield pd.DataFrame({"i": np.arange(2 * k, dtype=np.int32), "v": s})

    return totals


def _with_rate(k, cap, start, residuals, scale):
    def rate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            t, m, src = _memberships(pdf, k)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "source": pdf["source"], "n_tokens": pdf["n_tokens"], "rate": _rates(t, m, src, cap, start, residuals, scale), "p": pdf["p"]})

    return rate


def mixed(docs: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY, used: float = USED) -> tuple[DataFrame, dict]:
    """(mix, report). mix: (``doc_id``, ``source``, ``n_tokens``, ``rate``, ``repeats``, ``p``) of all documents with a text.

    The mix is as large as repeats allow, times ``used``. A document without a source, or of a source
    without target, gets 0 repeats but counts for the classifier's vocabulary; a target whose source has
    no documents is left out and the others are scaled up. Shares or repeats that are null or not
    positive count as 0. A repeated target counts with its largest share. Empty tables give an empty mix.
    """
    spark = docs.sparkSession
    wanted = targets.filter("target_share > 0 and max_repeats > 0 and source is not null").groupBy("source").agg(F.max("target_share").alias("w"), F.max("max_repeats").alias("c")).orderBy("source").collect()
    if not wanted:
        return docs.select("doc_id", "source", F.lit(0).alias("n_tokens"), F.lit(0.0).alias("rate"), F.lit(0).alias("repeats"), F.array(F.lit(0.0)).alias("p")).limit(0), {}
    names = [r["source"] for r in wanted]
    k = len(names)
    index = F.coalesce(F.array_position(F.array(*[F.lit(n) for n in names]), F.col("source")).cast("int") - 1, F.lit(-1))
    rows = durable(measured(docs, ["doc_id", "source"], vocabulary, with_ids=True).withColumn("k", index), "tokens")
    have = {r["k"]: (r["t"], r["n"]) for r in rows.groupBy("k").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n")).collect()}
    share = np.array([r["w"] if i in have else 0.0 for i, r in enumerate(wanted)])
    cap = np.array([float(r["c"]) for r in wanted])
    mass = np.array([float(have[i][0]) if i in have else 0.0 for i in range(k)])
    if not share.sum():
        return rows.select("doc_id", "source", "n_tokens", F.lit(0.0).alias("rate"), F.lit(0).alias("repeats"), F.array(F.lit(0.0)).alias("p")), {}
    share = share / share.sum()
    total = used * min(cap[i] * mass[i] / share[i] for i in range(k) if share[i])
    # The classifier: a table of at most k * VOCAB counts
    counts = rows.select("k", "ids").mapInArrow(_count(k), "k int, t int, n double").groupBy("k", "t").agg(F.sum("n").alias("n")).toArrow()
    table = np.full((k, VOCAB), 0.5)
    np.add.at(table, (counts.column("k").to_numpy(), counts.column("t").to_numpy()), counts.column("n").to_numpy())
    logp = np.log(table / table.sum(1, keepdims=True))
    logp -= logp.mean(0)
    docs_of = np.array([have[i][1] if i in have else 0.5 for i in range(k)], float)
    prior = np.log(docs_of / docs_of.sum())
    losses = rows.select("k", "ids").mapInArrow(_losses(logp, prior), "i int, loss double").groupBy("i").agg(F.sum("loss").alias("loss")).collect()
    temperature = TEMPERATURES[min(((r["loss"], r["i"]) for r in losses), default=(0, 0))[1]]
    ready = durable(rows.mapInArrow(_posterior(logp, prior, temperature), "doc_id long, source string, k int, n_tokens int, p array<double>"), "posteriors")
    # Targets: soft totals at the wanted shares beside stated totals at the wanted shares
    goal = np.concatenate([SOFT * share * total, share * total])
    start = np.array([min(cap[i], share[i] * total / mass[i]) if mass[i] else 0.0 for i in range(k)])
    residuals: list[np.ndarray] = []
    curve = np.zeros(4 * k * k)
    for r in ready.mapInPandas(_curvature(k), "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
        curve[r["i"]] = r["v"]
    scale = 1.0 / max(1.0, float(np.linalg.eigvalsh(curve.reshape(2 * k, 2 * k)).max()))
    history = []
    for _ in range(ITERATIONS):
        got = {r["i"]: r["v"] for r in ready.mapInPandas(_totals(k, cap, start, residuals, scale), "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()}
        res = np.array([got.get(i, 0.0) for i in range(2 * k)]) - goal
        history.append(float(np.abs(res).max() / total))
        if history[-1] < 1e-3:
            break
        residuals.append(res)
    rated = durable(ready.mapInPandas(_with_rate(k, cap, start, residuals, scale), "doc_id long, source string, n_tokens int, rate double, p array<double>"), "rated")
    # Whole repeats: floor(rate + u + shift), u a hash of the document; long texts are rounded first, the others make up for them.
    u = (F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(1 << 30)) / float(1 << 30)).alias("u")
    limits = spark.createDataFrame([(n, float(s * total), int(c)) for n, s, c in zip(names, share, cap)], "source string, goal double, top int")
    placed = rated.join(F.broadcast(limits), "source", "left").select("doc_id", "source", "n_tokens", "rate", "p", F.coalesce("goal", F.lit(0.0)).alias("goal"), F.coalesce("top", F.lit(0)).alias("top"), u)
    long_ = F.col("n_tokens") > F.col("goal") / 8
    lo, hi = {n: -cap.max() - 1 for n in names}, {n: cap.max() + 1 for n in names}

    def repeats(shift):
        by_shift = F.floor(F.col("rate") + F.col("u") + F.when(long_, 0.0).otherwise(shift))
        return F.greatest(F.lit(0), F.least(F.col("top"), by_shift)).cast("int")

    for _ in range(7):  # each pass narrows the shift sixteen times
        grid = {n: [lo[n] + (hi[n] - lo[n]) * j / 16 for j in range(17)] for n in names}
        sums = [F.sum(repeats(F.element_at(F.create_map(*[x for n in names for x in (F.lit(n), F.lit(float(grid[n][j])))]), F.col("source"))) * F.col("n_tokens").cast("long")).alias(f"s{j}") for j in range(17)]
        for r in placed.filter("top > 0").groupBy("source", "goal").agg(*sums).collect():
            j = max([j for j in range(17) if r[f"s{j}"] <= r["goal"]], default=0)
            lo[r["source"]], hi[r["source"]] = grid[r["source"]][j], grid[r["source"]][min(16, j + 1)]
    shift = F.element_at(F.create_map(*[x for n in names for x in (F.lit(n), F.lit(float(lo[n])))]), F.col("source"))
    out = placed.select("doc_id", "source", "n_tokens", "rate", F.when(F.col("top") > 0, repeats(shift)).otherwise(0).alias("repeats"), "p")
    return out, {"tokens": total, "temperature": temperature, "residuals": history, "sources": names}


def mix_report(mix: DataFrame, targets: DataFrame) -> DataFrame:
    """For each target source: ``target_share``, ``max_repeats``, ``docs_used``, ``most_repeats``, ``tokens``, ``share`` reached."""
    per = mix.groupBy("source").agg(
        F.sum((F.col("repeats") > 0).cast("long")).alias("docs_used"), F.max("repeats").alias("most_repeats"), F.sum(F.col("repeats").cast("long") * F.col("n_tokens")).alias("tokens")
    )
    whole = per.agg(F.sum("tokens").alias("all_tokens"))
    none = F.lit(0).cast("long")
    return targets.join(per, "source", "left").join(F.broadcast(whole), F.lit(True)).select(
        "source", "target_share", "max_repeats", F.coalesce("docs_used", none).alias("docs_used"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"),
        F.coalesce("tokens", none).alias("tokens"), (F.coalesce("tokens", none) / F.greatest(F.lit(1), F.col("all_tokens"))).alias("share"),
    )
