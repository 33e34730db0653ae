"""Quality of scores, decisions and clusters, each as an aggregate over the examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _part(x: Column, of: Column) -> Column:
    return F.coalesce(F.when(of > 0, x / of), F.lit(0.0))


def _f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)


def pr_at(scored: DataFrame, threshold: float, score: str = "score", label: str = "label", by: list[str] | None = None) -> DataFrame:
    """``precision``, ``recall``, ``f1`` of calling a match at ``threshold`` or above; empty denominators give 0."""
    hit, y = F.col(score) >= threshold, F.col(label) == 1
    a = scored.groupBy(*(by or [])).agg(F.sum(hit.cast("long")).alias("m"), F.sum((hit & y).cast("long")).alias("t"), F.sum(y.cast("long")).alias("p"))
    a = a.withColumn("precision", _part(F.col("t"), F.col("m"))).withColumn("recall", _part(F.col("t"), F.col("p")))
    return a.select(*(by or []), "precision", "recall", _f1(F.col("precision"), F.col("recall")).alias("f1"))


def score_steps(scored: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """One row for each distinct score from the top: ``s``, examples and positives at or above it, and all positives."""
    # Equal scores are one step, so the window runs over distinct scores, not examples.
    d = scored.groupBy(F.col(score).cast("double").alias("s")).agg(F.count("*").alias("n"), F.sum((F.col(label) == 1).cast("long")).alias("y"))
    down = Window.orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return d.select("s", "n", "y", F.sum("n").over(down).alias("m"), F.sum("y").over(down).alias("t"), F.sum("y").over(whole).alias("p"))


def average_precision(scored: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Sum over distinct scores of the gain in recall times precision; 0 if only one class is there."""
    s = score_steps(scored, score, label)
    a = s.agg(F.sum(F.col("y") / F.col("p") * F.col("t") / F.col("m")).alias("ap"), F.max("p").alias("p"), F.sum("n").alias("n"))
    return a.select(F.when((F.col("p") > 0) & (F.col("p") < F.col("n")), F.col("ap")).otherwise(0.0).alias("average_precision"))


def ece(scored: DataFrame, n_bins: int = 10, score: str = "score", label: str = "label") -> DataFrame:
    """Expected calibration error over equal bins, the last closed; 0 for no examples. Edges are those of a linear spacing in doubles."""
    b = calibration_curve(scored, n_bins, score, label)
    whole = b.agg(F.sum(F.col("n") * F.abs(F.col("mean_score") - F.col("mean_label"))).alias("g"), F.sum("n").alias("n"))
    return whole.select(_part(F.col("g"), F.col("n")).alias("ece"))


def _bin(score: Column, n_bins: int) -> Column:
    out = F.lit(n_bins - 1)
    for i in range(n_bins - 1, 0, -1):
        out = F.when(score < F.lit(float(i * (1.0 / n_bins))), i - 1).otherwise(out)
    return out


def calibration_curve(scored: DataFrame, n_bins: int, score: str = "score", label: str = "label") -> DataFrame:
    """Non-empty bins: ``bin``, ``n``, ``mean_score``, ``mean_label``."""
    return scored.filter(F.col(score).isNotNull()).groupBy(_bin(F.col(score), n_bins).alias("bin")).agg(F.count("*").alias("n"), F.avg(score).alias("mean_score"), F.avg(F.col(label).cast("double")).alias("mean_label"))


def brier(scored: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    return scored.agg(F.avg((F.col(score) - F.col(label)) * (F.col(score) - F.col(label))).alias("brier"))


def threshold_sweep(scored: DataFrame, n_points: int = 50, score: str = "score", label: str = "label") -> DataFrame:
    """Precision, recall and F1 at ``n_points`` thresholds between the least and the largest score ([0, 1] if they are equal), all rounded to 4 places.

    Each example falls between two thresholds; counts run over the few intervals, not over examples times thresholds.
    """
    lo, hi = scored.agg(F.min(score), F.max(score)).first()
    if lo is None:
        lo, hi = 0.0, 1.0
    if hi <= lo:
        lo, hi = 0.0, 1.0
    grid = [lo + (hi - lo) * i / (n_points - 1) for i in range(n_points - 1)] + [hi]
    hits = [F.sum((F.col(score) >= g).cast("long")).alias(f"m{i}") for i, g in enumerate(grid)] + [F.sum(((F.col(score) >= g) & (F.col(label) == 1)).cast("long")).alias(f"t{i}") for i, g in enumerate(grid)]
    one = scored.agg(F.sum((F.col(label) == 1).cast("long")).alias("p"), *hits)
    rows = one.select("p", F.explode(F.array(*[F.struct(F.lit(i).alias("point"), F.lit(g).alias("threshold"), F.col(f"m{i}").alias("m"), F.col(f"t{i}").alias("t")) for i, g in enumerate(grid)])).alias("x")).select("p", "x.*")
    rows = rows.withColumn("precision", _part(F.col("t"), F.col("m"))).withColumn("recall", _part(F.col("t"), F.col("p")))
    return rows.select("point", F.round("threshold", 4).alias("threshold"), F.round("precision", 4).alias("precision"), F.round("recall", 4).alias("recall"), F.round(_f1(F.col("precision"), F.col("recall")), 4).alias("f1"))


def best_threshold(scored: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """The threshold with the largest F1 among the distinct clipped scores in ascending order, then .35, .5, .65, .8; the earliest wins; .5 without examples."""
    clipped = scored.filter(F.col(score).isNotNull()).withColumn("_c", F.least(F.greatest(F.col(score).cast("double"), F.lit(0.0)), F.lit(1.0)))
    steps = score_steps(clipped, "_c", label)
    own = steps.select(F.col("s").alias("threshold"), "m", "t", "p", F.lit(0).alias("extra"))
    fixed = (0.35, 0.5, 0.65, 0.8)
    one = clipped.agg(F.sum((F.col(label) == 1).cast("long")).alias("p"), *[F.sum((F.col("_c") >= x).cast("long")).alias(f"m{i}") for i, x in enumerate(fixed)], *[F.sum(((F.col("_c") >= x) & (F.col(label) == 1)).cast("long")).alias(f"t{i}") for i, x in enumerate(fixed)])
    more = one.select("p", F.explode(F.array(*[F.struct(F.lit(x).alias("threshold"), F.col(f"m{i}").alias("m"), F.col(f"t{i}").alias("t"), F.lit(i + 1).alias("extra")) for i, x in enumerate(fixed)])).alias("x")).select("x.threshold", "x.m", "x.t", "p", "x.extra")
    every = own.unionByName(more.filter("p is not null"))
    p, r = _part(F.col("t"), F.col("m")), _part(F.col("t"), F.col("p"))
    ranked = every.withColumn("f1", F.round(_f1(p, r), 12))
    best = ranked.orderBy(F.desc("f1"), "extra", "threshold").limit(1).select("threshold", "f1")
    none = scored.sparkSession.createDataFrame([(0.5, 0.0)], "threshold double, f1 double")
    return best.withColumn("o", F.lit(0)).unionByName(none.withColumn("o", F.lit(1))).orderBy("o").limit(1).drop("o")


def histogram(scored: DataFrame, bins: int = 8, score: str = "score", label: str = "label") -> DataFrame:
    """``bin``, ``n`` and ``positives`` of equal bins over [0, 1]; empty bins are kept."""
    h = scored.filter(F.col(score).isNotNull()).groupBy(_bin(F.col(score), bins).alias("bin")).agg(F.count("*").alias("n"), F.sum((F.col(label) == 1).cast("long")).alias("positives"))
    spine = scored.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return spine.join(F.broadcast(h), "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("positives", F.lit(0)).alias("positives"))


def bcubed(clusters: DataFrame, gold: DataFrame) -> DataFrame:
    """B-cubed ``precision``, ``recall``, ``f1`` of (``id``, ``cluster``) against (``id``, ``gold``), over labelled ids; an id without a cluster is its own."""
    m = gold.filter("gold is not null").join(clusters, "id", "left").select(F.coalesce("cluster", F.concat(F.lit("#"), "id")).alias("c"), "gold")
    cell = m.groupBy("c", "gold").agg(F.count("*").alias("n"))
    by_c, by_g = cell.groupBy("c").agg(F.sum("n").alias("nc")), cell.groupBy("gold").agg(F.sum("n").alias("ng"))
    x = cell.join(by_c, "c").join(by_g, "gold")
    a = x.agg(F.sum(F.col("n") * F.col("n") / F.col("nc")).alias("p"), F.sum(F.col("n") * F.col("n") / F.col("ng")).alias("r"), F.sum("n").alias("n"))
    a = a.select(_part(F.col("p"), F.col("n")).alias("precision"), _part(F.col("r"), F.col("n")).alias("recall"))
    return a.withColumn("f1", _f1(F.col("precision"), F.col("recall")))


def confusion(decided: DataFrame, label: str = "label", decision: str = "decision") -> DataFrame:
    """Examples by label and decision."""
    a = [F.sum((F.col(decision) == d).cast("long")).alias(d) for d in ("match", "non_match", "abstain")]
    return decided.groupBy(F.col(label).alias("label")).agg(*a)


def agreement(scores: DataFrame, models: list[str]) -> DataFrame:
    """Share of examples on which two models (columns of ``scores``) fall on the same side of 0.5."""
    one = scores.agg(*[F.avg(((F.col(a) >= 0.5) == (F.col(b) >= 0.5)).cast("double")).alias(f"{a}|{b}") for a in models for b in models])
    return one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("model_a"), F.lit(b).alias("model_b"), F.col(f"`{a}|{b}`").alias("agreement")) for a in models for b in models])).alias("x")).select("x.*")


def wins_and_losses(scores: DataFrame, model: str, others: list[str], label: str = "label") -> DataFrame:
    """``outcome`` win (the model right, some other wrong) or loss (the model wrong, some other right) of each example that is either."""
    right = lambda c: (F.col(c) >= 0.5) == (F.col(label) == 1)
    some_wrong, some_right = F.lit(False), F.lit(False)
    for o in others:
        some_wrong, some_right = some_wrong | ~right(o), some_right | right(o)
    out = F.when(right(model) & some_wrong, "win").when(~right(model) & some_right, "loss")
    return scores.withColumn("outcome", out).filter("outcome is not null")


def leaderboard(scores: DataFrame, models: list[str], label: str = "label") -> DataFrame:
    """Precision, recall and F1 of each model at 0.5, best F1 first."""
    long_ = scores.select(F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("score"), F.col(label).alias("label")) for m in models])).alias("x")).select("x.*")
    return pr_at(long_, 0.5, by=["model"]).orderBy(F.desc("f1"), "model")


def average_folds(folds: DataFrame) -> DataFrame:
    """Means by ``model`` of fold metrics that were rounded to 3 places first."""
    cols = ["precision", "recall", "f1", "average_precision"]
    return folds.groupBy("model").agg(*[F.round(F.avg(F.round(c, 3)), 3).alias(c) for c in cols])


#: Predicates of the failure slices, in their order.
def slice_predicates() -> dict[str, Column]:
    f = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return {
        "same_name_collision": (f("name_similarity") >= 0.98) & (F.col("label") == 0),
        "location_conflict": f("location_conflict") >= 1,
        "sparse_overlap": (f("shared_domain_count") == 0) & (f("org_overlap_count") == 0) & (f("topic_overlap_count") <= 1),
        "cross_source_true_match": (f("same_source_type") == 0) & (F.col("label") == 1),
    }


def failure_slices(decided: DataFrame) -> DataFrame:
    """Decision-based precision, recall and F1 of each slice that has examples, rounded to 3 places."""
    marks = F.array_compact(F.array(*[F.when(p, n) for n, p in slice_predicates().items()]))
    s = decided.select(F.explode(marks).alias("slice"), "label", "decision")
    hit, y = F.col("decision") == "match", F.col("label") == 1
    a = s.groupBy("slice").agg(F.count("*").alias("n"), F.sum(hit.cast("long")).alias("m"), F.sum((hit & y).cast("long")).alias("t"), F.sum(y.cast("long")).alias("p"))
    a = a.withColumn("precision", _part(F.col("t"), F.col("m"))).withColumn("recall", _part(F.col("t"), F.col("p")))
    return a.select("slice", "n", F.round("precision", 3).alias("precision"), F.round("recall", 3).alias("recall"), F.round(_f1(F.col("precision"), F.col("recall")), 3).alias("f1"))


def top_errors(decided: DataFrame, k: int = 4) -> DataFrame:
    """The ``k`` worst false positives, false negatives and abstentions by the score rounded to 3 places; ties by the pair's ids."""
    s = F.round("score", 3)
    bucket = F.when((F.col("label") == 0) & (F.col("decision") == "match"), "false_positive").when((F.col("label") == 1) & (F.col("decision") == "non_match"), "false_negative").when(F.col("decision") == "abstain", "abstain")
    key = F.when(F.col("bucket") == "false_positive", -F.col("s")).when(F.col("bucket") == "false_negative", F.col("s")).otherwise(F.round(F.abs(F.col("s") - 0.5), 3))
    rows = decided.withColumn("bucket", bucket).filter("bucket is not null").withColumn("s", s)
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy(key, "left_profile_id", "right_profile_id"))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= k).select("bucket", "rank", "left_profile_id", "right_profile_id", "label", "decision", F.col("s").alias("score"))


def field_completeness(profiles: DataFrame, by: str = "source_type") -> DataFrame:
    """Share of rows, in percent, with a non-empty value in each of ten fields, by source."""
    texts, lists = ["display_name", "headline", "bio_text"], ["organizations", "locations", "topics", "outbound_links", "timestamps", "aliases", "education"]
    full = [(c, F.coalesce(F.col(c), F.lit("")) != "") for c in texts] + [(c, F.coalesce(F.size(c), F.lit(0)) > 0) for c in lists]
    one = profiles.groupBy(by).agg(*[F.avg(f.cast("double") * 100).alias(c) for c, f in full])
    return one.select(by, F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("percent")) for c, _ in full])).alias("x")).select(by, "x.*")


def complementarity(members: DataFrame, profiles: DataFrame) -> DataFrame:
    """For each member of a cluster (``cluster``, ``profile_id``) and field 1 if the profile fills it, else 0."""
    texts, lists = ["headline", "bio_text"], ["organizations", "locations", "topics", "outbound_links", "timestamps", "education"]
    cells = [F.struct(F.lit(c).alias("field"), (F.coalesce(F.col(c), F.lit("")) != "").cast("int").alias("filled")) for c in texts] + [F.struct(F.lit(c).alias("field"), (F.coalesce(F.size(c), F.lit(0)) > 0).cast("int").alias("filled")) for c in lists]
    return members.join(profiles, "profile_id").select("cluster", "profile_id", F.explode(F.array(*cells)).alias("x")).select("cluster", "profile_id", "x.*")


def pair_explorer(pairs: DataFrame, decisions: list[str], low: float, high: float) -> DataFrame:
    """Pairs with one of the decisions and a score in the closed range."""
    return pairs.filter(F.col("decision").isin(*decisions) & F.col("score").between(low, high))
