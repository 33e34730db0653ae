"""The whole evaluation: split, block, featurise, fit, decide, cluster, measure, report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.durable import durable
from kinweave.operators import blocking as B
from kinweave.operators import clusters as C
from kinweave.operators import evidence as V
from kinweave.operators import features as X
from kinweave.operators import leakage as L
from kinweave.operators import live as Q
from kinweave.operators import metrics as M
from kinweave.operators import models as D
from kinweave.operators import profile_keys as K
from kinweave.operators import splits as S
from kinweave.operators import tfidf as T

SEEDS = (7, 11, 17)


def vectors(profiles: DataFrame, idf: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(weights, idf) of the normalised texts; with ``idf`` given, terms it lacks drop out."""
    t = profiles.select(F.col("profile_id").alias("id"), K.normalized_text().alias("text"))
    tf = T.terms(t)
    idf = T.fit_idf(tf, t.count()) if idf is None else idf
    return T.weights(tf, idf), idf


def split_examples(profiles: DataFrame, split: str | None, idf: DataFrame | None = None, text: bool = True, k: int = 3, **how) -> DataFrame:
    """Candidates blocked among these profiles alone, with features; the cosine uses ``idf`` (fitted on train), neighbours their own fit."""
    keys = durable(K.profile_keys(profiles), "keys")
    own, _ = vectors(profiles)
    candidates = durable(B.block(keys, T.neighbours(own, k), **how), "candidates")
    w, _ = vectors(profiles, idf)
    cos = T.pair_cosine(candidates.select(*B.PAIR), w, *B.PAIR)
    return durable(X.pair_examples(candidates, keys, cos, text, split), "examples")


def run_fold(profiles: DataFrame, seed: int, **how) -> dict | None:
    """One seed: splits, examples, baselines and matcher; None if a split has no examples."""
    assignment = durable(S.assign_splits_seeded(profiles, seed), "splits")
    parts = {s: S.of_split(profiles, assignment, s) for s in S.SPLITS}
    _, idf = vectors(parts["train"])
    idf = durable(idf, "idf")
    fit_ids = durable(parts["train"].select(F.col("profile_id").alias("id")).distinct(), "fit_ids")
    ex = {s: split_examples(p, s, idf, **how) for s, p in parts.items()}
    if any(e.isEmpty() for e in ex.values()):
        return None
    matcher = D.train_matcher(ex["train"], ex["validation"])
    tests = {"fuzzy_name": D.name_baseline(ex["test"]), "embedding_only": D.embedding_baseline(ex["test"]), "lexical_baseline": D.lexical_baseline(ex["train"], ex["test"]), "hybrid": matcher.score(ex["test"])}
    vals = {"fuzzy_name": D.name_baseline(ex["validation"]), "embedding_only": D.embedding_baseline(ex["validation"]), "lexical_baseline": D.lexical_baseline(ex["train"], ex["validation"])}
    rows = []
    for name, scored in tests.items():
        t = matcher.threshold if name == "hybrid" else M.best_threshold(vals[name]).first()["threshold"]
        p, r, f = M.pr_at(scored, t).first()
        rows.append((seed, name, float(p), float(r), float(f), float(M.average_precision(scored).first()[0])))
    return {"seed": seed, "assignment": assignment, "idf": idf, "fit_ids": fit_ids, "parts": parts, "examples": ex, "matcher": matcher, "decided": durable(tests["hybrid"], "decided"), "metrics": rows}


def permutation_sanity(train: DataFrame, test: DataFrame, seed: int, threshold: float = 0.5) -> DataFrame:
    """Metrics after the training labels were shuffled: they should be poor."""
    from pyspark.sql import Window

    keys = ["left_profile_id", "right_profile_id"]
    rank = F.row_number().over(Window.orderBy(*keys))
    mixed = F.row_number().over(Window.orderBy(F.xxhash64(F.lit(seed), *keys), *keys))
    shuffled = train.withColumn("k", rank).drop("label").join(train.select(mixed.alias("k"), "label"), "k").drop("k")
    c, b = D.fit_logistic(shuffled)
    return M.pr_at(test.withColumn("score", D.linear_score(c, b)), threshold)


def run_benchmark(profiles: DataFrame, seeds=SEEDS, stress: dict[str, DataFrame] | None = None, **how) -> dict[str, list[dict]]:
    """The report as lists of rows by section. Fold means over all valid seeds; slices, errors, clusters, leakage, ablations and retrieval from the first valid one."""
    spark = profiles.sparkSession
    folds = [f for s in seeds if (f := run_fold(profiles, s, **how)) is not None]
    if not folds:
        raise ValueError("no seed leaves examples in every split")
    first = folds[0]
    rows = [r for f in folds for r in f["metrics"]]
    table = spark.createDataFrame(rows, "seed int, model string, precision double, recall double, f1 double, average_precision double")
    decided, m = first["decided"], first["matcher"]
    full = durable(m.score(split_examples(profiles, None, None, **how)), "resolved")
    matches = full.filter("decision = 'match'")
    labels = durable(C.components(matches, vertices=profiles), "labels")
    gold = profiles.select(F.col("profile_id").alias("id"), F.col("canonical_person_id").alias("gold"))
    keys = K.profile_keys(profiles)
    queries = K.profile_keys(first["parts"]["test"])
    fold_weights, _ = vectors(profiles, first["idf"])
    fold_weights = durable(fold_weights, "weights")
    found = Q.resolve_live(queries, keys, m, text=True, query_weights=fold_weights, weights=fold_weights)
    same = B.gold_pairs(profiles)
    both = same.selectExpr("left_profile_id as query_id", "right_profile_id as profile_id").unionByName(same.selectExpr("right_profile_id as query_id", "left_profile_id as profile_id"))
    both = both.join(queries.select(F.col("profile_id").alias("query_id")), "query_id", "left_semi")
    tr, te = first["parts"]["train"], first["parts"]["test"]
    leak = L.person_disjoint(profiles.join(first["assignment"], "canonical_person_id")).unionByName(L.duplicate_urls(tr, te)).unionByName(L.near_duplicate_check(tr, te)).unionByName(L.synthetic_contamination(profiles))
    ids = lambda df: df.select(F.col("profile_id").alias("id")).distinct()
    leak = leak.unionByName(L.train_only_fit(first["fit_ids"], ids(tr), ids(te))).unionByName(L.threshold_provenance(first["examples"]["train"].unionByName(first["examples"]["test"]), m.chosen_on))
    take = lambda df: [r.asDict(recursive=True) for r in df.collect()]  # noqa: E731 - small result tables
    ablations = []
    for name, feats in D.ABLATIONS.items():
        a = D.train_matcher(first["examples"]["train"], first["examples"]["validation"], feats)
        ablations += take(M.pr_at(a.score(first["examples"]["test"]), a.threshold).withColumn("variant", F.lit(name)))
    out = {
        "folds": take(table), "mean": take(M.average_folds(table)), "brier": take(M.brier(decided)), "ece": take(M.ece(decided)), "abstain": take(D.abstain_stats(decided)), "slices": take(M.failure_slices(decided)),
        "errors": take(V.evidence_cards(M.top_errors(decided).join(decided.drop("label", "decision", "score"), ["left_profile_id", "right_profile_id"])).withColumn("counterfactuals", V.counterfactuals()).select("bucket", "rank", "left_profile_id", "right_profile_id", "label", "decision", "score", "reason_codes", "final_explanation", "counterfactuals")),
        "histogram": take(M.histogram(decided)), "leakage": take(leak), "ablations": ablations, "permutation": take(permutation_sanity(first["examples"]["train"], first["examples"]["test"], first["seed"])),
        "clusters": take(M.bcubed(labels.select(F.col("profile_id").alias("id"), F.col("entity_id").alias("cluster")), gold)), "blocking": take(B.rule_stats(full.select(*B.PAIR, F.col("blocking_reasons").alias("reasons")), same)),
        "retrieval": take(Q.open_world_recall(found, both)), "thresholds": [{"threshold": m.threshold, "match": m.match_threshold, "non_match": m.non_match_threshold, "calibrator": m.calibrator.kind}],
    }
    for name, p in (stress or {}).items():
        d = m.score(split_examples(p, None, None, **how))
        out[f"stress_{name}"] = take(D.abstain_stats(d))
    return out
