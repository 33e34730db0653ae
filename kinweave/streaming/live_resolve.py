"""Live resolution over a stream: every micro-batch of new profiles is resolved against the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kinweave.operators import blocking as B
from kinweave.operators import tfidf as T
from kinweave.operators.features import lexical, structured
from kinweave.operators.live import with_vectors
from kinweave.operators.models import Matcher
from kinweave.operators.profile_keys import normalized_text, profile_keys


def resolve_batch(batch: DataFrame, corpus_keys: DataFrame, matcher: Matcher, text: bool = True, idf: DataFrame | None = None, weights: DataFrame | None = None) -> DataFrame:
    """Scored pairs (new profile, corpus profile) that share a name variant or a domain; no new profile meets the whole corpus.

    ``weights`` are the corpus's TF-IDF weights under ``idf``, which the new texts are weighed with too; without them the cosine is 0.
    """
    mine = None if idf is None else T.weights(T.terms(batch.select(F.col("profile_id").alias("id"), normalized_text().alias("text"))), idf)
    new, corpus_keys = with_vectors(profile_keys(batch), mine), with_vectors(corpus_keys, weights)
    pairs = None
    for c in ("variants", "domains"):
        a = new.select(F.col("profile_id").alias("left_profile_id"), F.explode(c).alias("key"))
        b = corpus_keys.select(F.col("profile_id").alias("right_profile_id"), F.explode(c).alias("key"))
        p = a.join(b, "key").filter("left_profile_id <> right_profile_id").select(*B.PAIR)
        pairs = p if pairs is None else pairs.unionByName(p)
    a = new.select(F.col("profile_id").alias("left_profile_id"), F.struct("*").alias("l"))
    b = corpus_keys.select(F.col("profile_id").alias("right_profile_id"), F.struct("*").alias("r"))
    cols = structured() | (lexical() if text else {}) | {"embedding_cosine": T.sparse_dot("l.t", "l.w", "r.t", "r.w")}
    met = pairs.distinct().join(a, "left_profile_id").join(b, "right_profile_id")
    return matcher.score(met.select(*B.PAIR, *[v.alias(k) for k, v in cols.items()])).select(*B.PAIR, "score", "decision")


def resolve_stream(profiles: DataFrame, corpus_keys: DataFrame, matcher: Matcher, out: str, checkpoint: str, text: bool = True, once: bool = True, idf: DataFrame | None = None, weights: DataFrame | None = None) -> StreamingQuery:
    """Resolve a stream of profiles into Parquet under ``out``, one folder per batch, so that a repeated batch overwrites itself.

    ``checkpoint`` must be on storage that all executors share.
    """

    def each(batch: DataFrame, number: int) -> None:
        resolve_batch(batch.dropDuplicates(["profile_id"]), corpus_keys, matcher, text, idf, weights).write.mode("overwrite").parquet(f"{out}/batch={number}")

    w = profiles.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


