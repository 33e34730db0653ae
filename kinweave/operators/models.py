"""Scorers, calibration and the three-way decision."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.durable import durable, release
from kinweave.operators.features import FULL, LEXICAL, SEMANTIC, STRUCTURED, vectorized
from kinweave.operators.metrics import best_threshold, brier

#: The grid of abstain bands, in the order in which ties are decided, and thresholds tried besides the scores.
LOWER, UPPER = (0.15, 0.2, 0.25, 0.3, 0.35, 0.4), (0.6, 0.65, 0.7, 0.75, 0.8, 0.85)
ABLATIONS = {"full": FULL, "no_embedding": LEXICAL + STRUCTURED, "no_structured": LEXICAL + SEMANTIC}


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-F.least(F.greatest(x, F.lit(-500.0)), F.lit(500.0))))


def linear_score(coefficients: dict[str, float], intercept: float) -> Column:
    """A logistic score with given coefficients; a null feature counts as 0."""
    z = F.lit(float(intercept))
    for name, c in coefficients.items():  # every named feature must be there
        z = z + F.coalesce(F.col(name).cast("double"), F.lit(0.0)) * F.lit(float(c))
    return sigmoid(z)


def fit_logistic(examples: DataFrame, names: list[str] = FULL, label: str = "label", balanced: bool = True, max_iter: int = 200):
    """An L2 logistic regression with C = 1: coefficients are those of the penalised likelihood on the raw features.

    Returns (coefficients by name, intercept). One class only gives zero coefficients and its log-odds, clipped.
    """
    from pyspark.ml.classification import LogisticRegression

    n, pos = examples.agg(F.count("*"), F.sum(F.col(label).cast("double"))).first()
    pos = pos or 0.0
    if not n or pos in (0.0, float(n)):
        return {k: 0.0 for k in names}, (5.0 if pos else -5.0)
    weight = F.when(F.col(label) == 1, n / (2 * pos)).otherwise(n / (2 * (n - pos))) if balanced else F.lit(1.0)
    data = vectorized(examples, names).select("features", F.col(label).cast("double").alias("y"), weight.alias("wt"))
    data = durable(data, "examples")  # every iteration reads it
    total = data.agg(F.sum("wt")).first()[0]
    lr = LogisticRegression(featuresCol="features", labelCol="y", weightCol="wt", regParam=1.0 / total, elasticNetParam=0.0, standardization=False, maxIter=max_iter, tol=1e-9)
    model = lr.fit(data)
    release(data)
    return dict(zip(names, map(float, model.coefficients))), float(model.intercept)


@dataclass
class Calibrator:
    """identity, isotonic or sigmoid; ``apply`` maps a score column."""

    kind: str = "identity"
    knots: list[tuple[float, float]] = field(default_factory=list)
    slope: float = 1.0
    offset: float = 0.0

    def apply(self, score: Column) -> Column:
        if self.kind == "sigmoid":
            return sigmoid(score * self.slope + self.offset)
        if self.kind == "isotonic" and self.knots:
            # Two literals and a binary search, however many knots there are.
            x, y = (F.split(F.lit(",".join(repr(k[i]) for k in self.knots)), ",").cast("array<double>") for i in (0, 1))
            steps = F.array(*[F.lit(1 << k) for k in range(len(self.knots).bit_length() - 1, -1, -1)])
            at = F.aggregate(steps, F.lit(0), lambda lo, step: F.when(F.get(x, lo + step) <= score, lo + step).otherwise(lo))
            x0, y0, x1, y1 = F.get(x, at), F.get(y, at), F.get(x, at + 1), F.get(y, at + 1)
            between = y0 + F.when(x1 > x0, (score - x0) * (y1 - y0) / (x1 - x0)).otherwise(0.0)
            return F.when(score <= self.knots[0][0], F.lit(self.knots[0][1])).otherwise(F.coalesce(between, y0))
        return score


def fit_calibrators(scored: DataFrame, score: str = "score", label: str = "label") -> list[Calibrator]:
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import IsotonicRegression

    out = [Calibrator()]
    n, pos = scored.agg(F.count("*"), F.sum(F.col(label).cast("double"))).first()
    if n and pos not in (None, 0.0, float(n)):
        data = VectorAssembler(inputCols=["_s"], outputCol="features").transform(scored.select(F.col(score).cast("double").alias("_s"), F.col(label).cast("double").alias("label")))
        iso = IsotonicRegression(featuresCol="features", labelCol="label").fit(data)
        out.append(Calibrator("isotonic", [(float(a), min(1.0, max(0.0, float(b)))) for a, b in zip(iso.boundaries, iso.predictions)]))
        lr = LogisticRegression(regParam=1.0 / n, standardization=False, maxIter=200, tol=1e-9).fit(data)
        out.append(Calibrator("sigmoid", slope=float(lr.coefficients[0]), offset=float(lr.intercept)))
    return out


def best_calibrator(scored: DataFrame, score: str = "score", label: str = "label") -> Calibrator:
    """Of identity, isotonic and sigmoid the one with the least Brier score; ties go to the first named."""
    found = [(brier(scored.withColumn("_c", c.apply(F.col(score))), "_c", label).first()["brier"], i, c) for i, c in enumerate(fit_calibrators(scored, score, label))]
    return min(found, key=lambda x: (round(x[0], 12) if x[0] is not None else 0.0, x[1]))[2]


def abstain_grid(scored: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """For each band of the grid the accepted precision and recall, the abstain rate and the objective.

    One aggregate over the examples: each is counted for all 36 bands at once, without a join.
    """
    y, s = F.col(label) == 1, F.col(score)
    aggs = [F.count("*").alias("n"), F.sum(y.cast("long")).alias("pos")]
    for u in UPPER:
        aggs += [F.sum((s >= u).cast("long")).alias(f"m_{u}"), F.sum(((s >= u) & y).cast("long")).alias(f"t_{u}")]
    for lo in LOWER:
        aggs.append(F.sum((s <= lo).cast("long")).alias(f"r_{lo}"))
    one = scored.agg(*aggs)
    cells = F.array(*[
        F.struct(F.lit(i * len(UPPER) + j).alias("cell"), F.lit(lo).alias("lower"), F.lit(u).alias("upper"), F.col(f"`m_{u}`").alias("matched"), F.col(f"`t_{u}`").alias("true_matches"), F.col(f"`r_{lo}`").alias("rejected"), F.col("n").alias("n"), F.col("pos").alias("pos"))
        for i, lo in enumerate(LOWER) for j, u in enumerate(UPPER)
    ])
    c = one.select(F.explode(cells).alias("c")).select("c.*")
    precision = F.when(F.col("matched") > 0, F.col("true_matches") / F.col("matched")).otherwise(0.0)
    recall = F.when(F.col("pos") > 0, F.col("true_matches") / F.col("pos")).otherwise(0.0)
    abstain = F.when(F.col("n") > 0, (F.col("n") - F.col("matched") - F.col("rejected")) / F.col("n")).otherwise(0.0)
    out = c.select("cell", "lower", "upper", "matched", precision.alias("precision"), recall.alias("recall"), abstain.alias("abstain_rate"))
    return out.withColumn("objective", F.col("precision") + 0.25 * F.col("recall") - 0.1 * F.col("abstain_rate"))


def abstain_band(scored: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """The best band (``lower``, ``upper``): largest objective, then precision, recall, abstain rate, then the first; bands without a match don't count. Without any band no row."""
    g = abstain_grid(scored, score, label).filter("matched > 0")
    return g.orderBy(F.desc(F.round("objective", 9)), F.desc(F.round("precision", 9)), F.desc(F.round("recall", 9)), F.desc(F.round("abstain_rate", 9)), "cell").limit(1).select("lower", "upper", "precision", "recall", "abstain_rate")


def abstain_stats(decided: DataFrame, decision: str = "decision", label: str = "label") -> DataFrame:
    """``accepted_precision``, ``accepted_recall`` (over all positives) and ``abstain_rate``."""
    match, y = F.col(decision) == "match", F.col(label) == 1
    a = decided.agg(F.count("*").alias("n"), F.sum(match.cast("long")).alias("m"), F.sum((match & y).cast("long")).alias("t"), F.sum(y.cast("long")).alias("p"), F.sum((F.col(decision) == "abstain").cast("long")).alias("a"))
    part = lambda x, of: F.coalesce(F.when(F.col(of) > 0, F.col(x) / F.col(of)), F.lit(0.0))
    return a.select(part("t", "m").alias("accepted_precision"), part("t", "p").alias("accepted_recall"), part("a", "n").alias("abstain_rate"))


def contradiction_veto(score: Column, match_threshold: float, have: list[str]) -> Column:
    """``have``: the columns there are; a feature that is missing or null counts as 0. A pair that would match, or has the same name, but whose places conflict and that shares neither organisation nor domain nor two topics."""
    f = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in have else F.lit(0.0)
    return (f("location_conflict") >= 1) & (f("org_overlap_count") == 0) & (f("shared_domain_count") == 0) & (f("topic_overlap_count") <= 1) & ((score >= match_threshold) | (f("name_similarity") >= 0.98))


def decide(examples: DataFrame, match_threshold: float, non_match_threshold: float, score: str = "score") -> DataFrame:
    """``decision``: abstain by veto, else match, non_match or abstain by the two thresholds."""
    s = F.col(score)
    return examples.withColumn("decision", F.when(contradiction_veto(s, match_threshold, examples.columns), "abstain").when(s >= match_threshold, "match").when(s <= non_match_threshold, "non_match").otherwise("abstain"))


@dataclass
class Matcher:
    """A fitted scorer with its calibrator and thresholds; ``adjudicate`` may replace a score (a column of it, or null to keep)."""

    names: list[str]
    coefficients: dict[str, float]
    intercept: float
    calibrator: Calibrator
    threshold: float
    match_threshold: float
    non_match_threshold: float
    adjudicate: Callable[[DataFrame], Column] | None = None
    #: The pairs (``left_profile_id``, ``right_profile_id``, ``split``) that calibrator and thresholds were chosen on.
    chosen_on: DataFrame | None = None

    def score(self, examples: DataFrame) -> DataFrame:
        out = examples.withColumn("raw_score", linear_score(self.coefficients, self.intercept))
        out = out.withColumn("score", self.calibrator.apply(F.col("raw_score")))
        if self.adjudicate is not None:
            out = out.withColumn("score", F.coalesce(self.adjudicate(out), F.col("score")))
        return decide(out, self.match_threshold, self.non_match_threshold)


def train_matcher(train: DataFrame, validation: DataFrame, names: list[str] = FULL, adjudicate=None) -> Matcher:
    """Fit on train; calibrate and choose thresholds on validation alone."""
    coefficients, intercept = fit_logistic(train, names)
    raw = validation.withColumn("score", linear_score(coefficients, intercept))
    calibrator = best_calibrator(raw)
    val = raw.withColumn("score", calibrator.apply(F.col("score")))
    t = best_threshold(val).first()["threshold"]
    band = abstain_band(val).first()
    lower, upper = (band["lower"], band["upper"]) if band else (min(t, 0.4), max(t, 0.6))
    seen = durable(validation.select("left_profile_id", "right_profile_id", F.col("split") if "split" in validation.columns else F.lit(None).cast("string").alias("split")), "chosen_on")
    return Matcher(names, coefficients, intercept, calibrator, t, upper, lower, adjudicate, seen)


def name_baseline(examples: DataFrame) -> DataFrame:
    return examples.withColumn("score", F.col("name_similarity"))


def embedding_baseline(examples: DataFrame) -> DataFrame:
    return examples.withColumn("score", F.col("embedding_cosine"))


def lexical_baseline(train: DataFrame, examples: DataFrame) -> DataFrame:
    c, b = fit_logistic(train, LEXICAL)
    return examples.withColumn("score", linear_score(c, b))


def waterfall(examples: DataFrame, coefficients: dict[str, float], intercept: float, keys: list[str]) -> DataFrame:
    """For each example one row a feature: ``value``, ``contribution``, running ``log_odds`` from the intercept and its ``probability``."""
    steps = F.array(*[F.struct(F.lit(i).alias("step"), F.lit(n).alias("feature"), F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias("value"), (F.coalesce(F.col(n).cast("double"), F.lit(0.0)) * F.lit(float(c)) + 0.0).alias("contribution")) for i, (n, c) in enumerate(coefficients.items())])
    rows = examples.select(*keys, F.explode(steps).alias("x")).select(*keys, "x.*")
    run = F.lit(float(intercept)) + F.sum("contribution").over(Window.partitionBy(*keys).orderBy("step").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("log_odds", run).withColumn("probability", sigmoid(F.col("log_odds")))


def mean_contribution(examples: DataFrame, coefficients: dict[str, float]) -> DataFrame:
    """Mean absolute contribution of each feature."""
    one = examples.agg(*[F.avg(F.abs(F.coalesce(F.col(n).cast("double"), F.lit(0.0)) * F.lit(float(c)))).alias(n) for n, c in coefficients.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("mean_abs")) for n in coefficients])).alias("x")).select("x.*")


def coefficient_ranking(spark, coefficients: dict[str, float]) -> DataFrame:
    return spark.createDataFrame([(k, float(v)) for k, v in coefficients.items()], "feature string, coefficient double").orderBy(F.desc(F.abs("coefficient")), "feature")


def pca_2d(examples: DataFrame, names: list[str] = FULL) -> DataFrame:
    """Two principal components of the centred features; their signs are arbitrary."""
    from pyspark.ml.feature import PCA, StandardScaler

    data = vectorized(examples, names)
    centred = StandardScaler(inputCol="features", outputCol="centred", withMean=True, withStd=False).fit(data).transform(data)
    return PCA(k=2, inputCol="centred", outputCol="pca").fit(centred).transform(centred)
