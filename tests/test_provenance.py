"""What thresholds were chosen on, calibrators with many knots, packed vectors, and where intermediate tables go."""

import bisect

import pytest
from pyspark.sql import functions as F

from kinweave import durable as DU
from kinweave.operators import leakage as L
from kinweave.operators import live as Q
from kinweave.operators import models as D
from kinweave.operators import profile_keys as K
from kinweave.operators import tfidf as T

PAIR = "left_profile_id string, right_profile_id string, split string"


def test_thresholds_chosen_elsewhere_are_found(spark):
    examples = spark.createDataFrame([("a", "b", "train"), ("c", "d", "validation"), ("e", "f", "test"), ("g", "h", None)], PAIR)
    good = spark.createDataFrame([("c", "d", "validation"), ("c", "d", "validation")], PAIR)
    assert tuple(L.threshold_provenance(examples, good).first())[1:] == (True, 0)
    bad = spark.createDataFrame([("c", "d", "validation"), ("e", "f", "validation"), ("x", "y", "train"), ("u", "v", None)], PAIR)
    assert tuple(L.threshold_provenance(examples, bad).first())[1:] == (False, 3)
    assert L.threshold_provenance(examples.limit(0), good.limit(0)).first()["passed"]


def test_isotonic_with_thousands_of_knots(spark):
    knots = [(i / 3000, (i // 7) / 450) for i in range(3000)]
    c = D.Calibrator("isotonic", knots)
    scores = [i / 997 - 0.1 for i in range(1300)]

    def want(s):
        if s <= knots[0][0]:
            return knots[0][1]
        i = bisect.bisect_right([k[0] for k in knots], s) - 1
        if i == len(knots) - 1:
            return knots[-1][1]
        (x0, y0), (x1, y1) = knots[i], knots[i + 1]
        return y0 + (s - x0) * (y1 - y0) / (x1 - x0)

    df = spark.createDataFrame([(float(s),) for s in scores], "s double")
    got = {r["s"]: r["c"] for r in df.select("s", c.apply(F.col("s")).alias("c")).collect()}
    assert all(abs(got[s] - want(s)) < 1e-9 for s in scores)
    one = D.Calibrator("isotonic", [(0.5, 0.2)])
    assert [r[0] for r in df.limit(3).select(one.apply(F.col("s"))).collect()] == [0.2] * 3


def test_packed_cosine_is_the_cosine(spark):
    texts = spark.createDataFrame([("a", "red fox red"), ("b", "red dog"), ("c", ""), ("d", None)], "id string, text string")
    tf = T.terms(texts)
    w = T.weights(tf, T.fit_idf(tf, 4))
    want = {(r["id"], r["other"]): r["cosine"] for r in T.cosine_pairs(w).collect()}
    pairs = spark.createDataFrame([("a", "b"), ("a", "c"), ("c", "d"), ("a", "zz")], "l string, r string")
    got = {(r["l"], r["r"]): r["embedding_cosine"] for r in T.pair_cosine(pairs, w, "l", "r").collect()}
    assert abs(got.pop(("a", "b")) - want["a", "b"]) < 1e-9 and set(got.values()) == {0.0}


def test_live_scores_use_the_text(spark, make_profiles):
    corpus = make_profiles([{"bio_text": "graph storage engines"}, {"bio_text": "baroque violin making"}])
    asked = make_profiles([{"profile_id": "q", "display_name": "Zed Other", "bio_text": "storage engines for a graph"}])
    text = lambda p: p.select(F.col("profile_id").alias("id"), K.normalized_text().alias("text"))
    tf = T.terms(text(corpus))
    idf = T.fit_idf(tf, 2)
    m = D.Matcher(["embedding_cosine"], {"embedding_cosine": 5.0}, -2.0, D.Calibrator(), 0.5, 0.6, 0.3)
    found = Q.resolve_live(K.profile_keys(asked), K.profile_keys(corpus), m, text=False, query_weights=T.weights(T.terms(text(asked)), idf), weights=T.weights(tf, idf))
    first, second = sorted(found.collect(), key=lambda r: r["rank"])
    assert first["profile_id"] == "p000" and first["score"] > second["score"]


def test_a_cluster_without_a_shared_folder_is_an_error(monkeypatch):
    class Context:
        master = "spark://somewhere:7077"

        class _jsc:
            @staticmethod
            def sc():
                class S:
                    @staticmethod
                    def getCheckpointDir():
                        return type("none", (), {"isDefined": staticmethod(lambda: False)})

                return S

    class Session:
        sparkContext = Context

        class conf:
            @staticmethod
            def get(name, default=None):
                return default

    with pytest.raises(RuntimeError):
        DU.shared_dir(Session)
