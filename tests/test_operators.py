"""Operators against plain Python, and their behaviour on empty, null, repeated and clashing input."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from kinweave.operators import blocking as B
from kinweave.operators import clusters as C
from kinweave.operators import ingest as I
from kinweave.operators import metrics as M
from kinweave.operators import models as D
from kinweave.operators import splits as S
from kinweave.operators.evidence import evidence_cards
from kinweave.operators.features import joined, lexical, structured
from kinweave.operators.profile_keys import profile_keys
from kinweave.sources import datasets as DS
from kinweave.sources import schemas as SC
from kinweave.sources import web as W


def pairs(df):
    return {(r[0], r[1]) for r in df.select("left_profile_id", "right_profile_id").collect()}


def test_similar_names_lose_no_pair(spark):
    random.seed(5)
    base = ["maria lopez", "mario lopez", "anna", "ana", "a", "ab", "b", "jonathan smithers", "jonathon smithers", "aaaa bbbb", "aaab bbbb", "li", "il"]
    names = base + ["".join(random.choice("abc ") for _ in range(random.randint(1, 9))).strip() or "x" for _ in range(60)]
    want = {(a, b) for a in set(" ".join(n.split()) for n in names) for b in set(" ".join(n.split()) for n in names) if a != b and SequenceMatcher(None, a, b).ratio() >= 0.85}
    got = {(r["a"], r["b"]) for r in B.similar_name_pairs(spark.createDataFrame([(n,) for n in names], "name string")).collect()}
    assert got == want


def test_rules_equal_a_comparison_of_all_pairs(spark, make_profiles):
    random.seed(2)
    rows = [{"display_name": random.choice(["Ada Lovelace", "A. Lovelace", "Bob Stone", "bob  stone", "Cy Twombly"]), "topics": random.sample(["graph search", "graph theory", "deep search", "sparse maps"], 2), "organizations": random.sample(["Acme Labs", "Beta Group", "Acme Group"], 1), "outbound_links": random.sample(["https://a.example/x", "https://www.a.example/y", "https://b.example"], 1), "source_type": random.choice(["github", "personal_site"])} for _ in range(25)]
    keys = profile_keys(make_profiles(rows)).collect()
    tokens = {k["profile_id"]: k for k in keys}
    df = profile_keys(make_profiles(rows))
    ids = sorted(tokens)
    every = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :]]
    both = lambda a, b, c: len(set(tokens[a][c]) & set(tokens[b][c]))
    assert pairs(B.alias_or_initial(df)) == {p for p in every if both(*p, "variants")}
    assert pairs(B.shared_domain(df)) == {p for p in every if both(*p, "domains")}
    assert pairs(B.org_or_topic_overlap(df)) == {p for p in every if both(*p, "org_tokens") or both(*p, "topic_tokens") >= 2}


def test_blocking_of_nulls_and_nothing(spark, make_profiles):
    p = make_profiles([{"display_name": None, "aliases": None, "topics": None, "organizations": None, "outbound_links": None, "url": None, "locations": None, "timestamps": None}, {"display_name": ""}])
    keys = profile_keys(p)
    assert B.rule_reasons(keys).count() == 0
    assert B.rule_reasons(keys.limit(0)).count() == 0
    assert B.blocking_recall(B.alias_or_initial(keys), B.gold_pairs(p)).first()["recall"] == 0.0


def test_features_of_empty_sides_are_zero(spark, make_profiles):
    keys = profile_keys(make_profiles([{"headline": None, "bio_text": None}, {"locations": ["Rome"], "timestamps": ["2001-05"]}]))
    j = joined(spark.createDataFrame([("p000", "p001")], "left_profile_id string, right_profile_id string"), keys)
    r = j.select(*[v.alias(k) for k, v in (structured() | lexical()).items()]).first()
    assert r["org_jaccard"] == r["temporal_distance"] == r["location_conflict"] == r["headline_similarity"] == r["bio_similarity"] == 0.0
    assert r["name_similarity"] == 1.0


def test_components_against_union_find(spark):
    random.seed(3)
    ids = [f"v{i:03}" for i in range(60)]
    edges = [(random.choice(ids), random.choice(ids)) for _ in range(45)] + [("v000", None), ("v001", "v001")] * 2
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if b and find(a) != find(b):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    df = spark.createDataFrame([(*e, 1) for e in edges], "left_profile_id string, right_profile_id string, entity_id int")
    got = {r["profile_id"]: r["entity_id"] for r in C.components(df, vertices=spark.createDataFrame([(i,) for i in ids], "profile_id string")).collect()}
    assert got == {i: find(i) for i in ids}
    assert C.components(df.limit(0)).count() == 0


def test_metrics_of_nothing_and_one_class(spark):
    none = spark.createDataFrame([], "score double, label int")
    assert M.pr_at(none, 0.5).first()["f1"] == 0.0
    assert M.average_precision(none).first()[0] == 0.0
    assert M.ece(none).first()[0] == 0.0
    assert M.best_threshold(none).first()["threshold"] == 0.5
    one = spark.createDataFrame([(0.2, 1), (0.9, 1)], "score double, label int")
    assert M.average_precision(one).first()[0] == 0.0
    assert M.threshold_sweep(one).count() == 50


def test_logistic_equals_a_newton_solve(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 2))
    y = (x @ [1.5, -1.0] + rng.normal(size=200) > 0.7).astype(int)
    df = spark.createDataFrame([(float(a), float(b), int(c)) for (a, b), c in zip(x, y)], "a double, b double, label int")
    c, b0 = D.fit_logistic(df, ["a", "b"])
    w = np.where(y == 1, 200 / (2 * y.sum()), 200 / (2 * (200 - y.sum())))
    z, t = np.c_[x, np.ones(200)], np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ t))
        g = z.T @ (w * (p - y)) + np.array([t[0], t[1], 0])
        h = (z * (w * p * (1 - p))[:, None]).T @ z + np.diag([1, 1, 0])
        t = t - np.linalg.solve(h, g)
    assert np.allclose([c["a"], c["b"], b0], t, atol=1e-3)


def test_matcher_end_to_end(spark):
    random.seed(1)
    rows = [(f"a{i}", f"b{i}", i % 2, float(i % 2) * 0.6 + random.random() * 0.4, 0.0, 0.0) for i in range(120)]
    e = spark.createDataFrame(rows, "left_profile_id string, right_profile_id string, label int, name_similarity double, location_conflict double, org_overlap_count double")
    m = D.train_matcher(e, e, ["name_similarity"])
    got = m.score(e)
    assert got.filter("decision = 'match' and label = 0").count() == 0
    assert got.filter("decision = 'match'").count() > 40
    cards = evidence_cards(got.withColumn("shared_domain_count", F.lit(1.0)).withColumn("topic_overlap_count", F.lit(0.0))).first()
    assert "shared_domain" in cards["reason_codes"] and "Decision=" in cards["final_explanation"]


HTML = """<html><body><h1 class='p-name'> Ada  Byron </h1><p class="p-note">Engineer</p><div class='user-profile-bio'>Wrote <b>notes</b></div>
<ul class=org-list><li data-name='Acme' data-role='Lead' data-start-year='2001'></li><li>Beta</ul><ul class='topic-list'><li>maps<li>graphs</ul><div class='profile-links'><a href='https://a.example'>x</a><a>no</a></div>"""


def test_pages_parse_even_if_broken(spark):
    rows = [
        ("x_raw", "github", "https://g.example/x", None, None, None, None, HTML, "raw"), ("y_raw", "podcast_guest", "https://p.example/y", "c", "Hint Name", None, "T", None, "only raw text"),
        ("z_raw", "unknown", "https://p.example/z", None, "N", None, None, "<p>", "r"), ("w_raw", "github", "https://p.example/w", None, None, None, None, "<p>", "r"),
    ]
    p = I.parse_pages(spark.createDataFrame(rows, SC.RAW_PAGE)).orderBy("profile_id").collect()
    assert [r["profile_id"] for r in p] == ["x", "y"]
    x, y = p
    assert x["display_name"] == "Ada  Byron" and x["headline"] == "Engineer" and x["organizations"][0]["start_year"] == 2001
    assert [o["name"] for o in x["organizations"]] == ["Acme", "Beta"] and x["outbound_links"] == ["https://a.example"]
    assert y["display_name"] == "Hint Name" and y["bio_text"] == "only raw text" and y["metadata"]["title"] == "T"
    with pytest.raises(Exception):
        I.parse_pages(spark.createDataFrame(rows[2:3], SC.RAW_PAGE), strict=True).collect()


def test_validation_names_the_broken_rules(spark, make_profiles):
    p = make_profiles([{"profile_id": "Bad Id", "source_type": "blog", "supporting_spans": None, "organizations": [("A", None, 2010, 2001)], "locations": [" ", "Rome "]}, {}])
    v = {r["profile_id"]: r for r in SC.validated(p).collect()}
    assert set(v["Bad Id"]["violations"]) == {"profile_id", "source_type", "supporting_spans", "organization_order"} and v["Bad Id"]["locations"] == ["Rome"]
    assert v["p001"]["violations"] == []
    with pytest.raises(Exception):
        SC.validated(p, strict=True).collect()


def test_datasets(spark, make_profiles):
    p = make_profiles([{"canonical_person_id": "b", "topics": ["x", "y", "z"]}, {"canonical_person_id": "a", "metadata": {"seed_group": "hard_negative"}}])
    assert DS.available_datasets() == ["real_curated_core", "hard_negative_bank", "synthetic_stress"]
    assert DS.load_dataset(p, "synthetic_stress").count() == 3
    assert DS.synthetic_positives(p).filter("canonical_person_id = 'b'").first()["topics"] == ["x", "y", "ai systems"]
    with pytest.raises(KeyError):
        DS.load_dataset(p, "nope")


def test_splits_are_disjoint_and_checked(spark, make_profiles):
    p = make_profiles([{"canonical_person_id": f"c{i // 2:02}"} for i in range(32)])
    a = S.assign_splits(p)
    assert {r["split"]: r["count"] for r in a.groupBy("split").count().collect()} == {"train": 9, "validation": 3, "test": 4}
    S.assert_person_disjoint(p.join(a, "canonical_person_id"))
    with pytest.raises(ValueError):
        S.assert_person_disjoint(spark.createDataFrame([("c", "train"), ("c", "test")], "canonical_person_id string, split string"))


def test_sources_outside_fail_softly(spark):
    def broken(*_):
        raise OSError

    urls = spark.createDataFrame([("https://github.com/x",)], "url string")
    assert W.pages_from_urls(urls, broken).count() == 0
    assert W.search(spark, "Ada", broken).count() == 0
    hits = W.search(spark, "Ada", lambda q, n: [{"title": "t", "href": "https://netflix.com/a", "body": "b"}, {"title": "u", "href": "https://netflix.com/a"}])
    assert W.hits_to_rows(hits).collect()[0]["source_type"] == "personal_site"
