"""The pipelines as a whole, on made profiles."""

import json
import random

import pytest
from pyspark.sql import functions as F

from kinweave.operators import models as D
from kinweave.operators.adjudicate import adjudication_prompt, ask, read_reply
from kinweave.operators.profile_keys import profile_keys
from kinweave.plans.benchmark import run_benchmark
from kinweave.sources.sinks import write_report
from kinweave.streaming.live_resolve import resolve_stream


@pytest.fixture(scope="module")
def people(make_profiles):
    random.seed(11)
    rows = []
    for k in range(16):
        name = f"{random.choice(['Ada', 'Bob', 'Cleo', 'Dan'])} {'Kor' + chr(97 + k) * 2 + 'vin'}"
        for j in range(3):
            rows.append({"profile_id": f"p{k:02}{j}", "canonical_person_id": f"c{k:02}", "display_name": name if j else name.upper(), "organizations": [f"Firm{k} Labs"], "topics": [f"topic{k} maps", "common work"], "outbound_links": [f"https://site{k}.example/a"], "source_type": ["github", "podcast_guest", "huggingface"][j], "bio_text": f"{name} works on topic{k} at Firm{k}.", "locations": [f"Town{k}"], "url": f"https://u{k}{j}.example/"})
    return make_profiles(rows)


def test_benchmark_and_report(spark, people, tmp_path):
    report = run_benchmark(people, seeds=(7,))
    assert {r["model"] for r in report["mean"]} == {"fuzzy_name", "embedding_only", "lexical_baseline", "hybrid"}
    assert [r["f1"] for r in report["mean"] if r["model"] == "hybrid"][0] >= 0.8
    assert report["clusters"][0]["f1"] >= 0.8
    assert all(r["passed"] for r in report["leakage"] if r["name"] == "canonical_person_disjoint")
    paths = write_report(report, str(tmp_path))
    assert json.loads(open(paths[0]).read()).keys() == report.keys()
    assert "<table>" in open(paths[1]).read()


def test_stream_is_resolved(spark, people, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    people.filter("profile_id like '%0'").write.parquet(str(source))
    corpus = profile_keys(people.filter("profile_id not like '%0'"))
    m = D.Matcher(["shared_domain_count"], {"shared_domain_count": 4.0, "org_overlap_count": 2.0}, -3.0, D.Calibrator(), 0.5, 0.6, 0.35)
    stream = spark.readStream.schema(people.schema).parquet(str(source))
    q = resolve_stream(stream, corpus, m, str(out), str(tmp_path / "check"), text=False)
    q.awaitTermination()
    got = spark.read.parquet(str(out)).filter("decision = 'match'")
    assert got.count() == 32 and got.filter(F.substring("left_profile_id", 1, 3) != F.substring("right_profile_id", 1, 3)).count() == 0


def test_adjudication_is_off_by_default_and_forgiving(spark, people):
    pair = people.filter("profile_id = 'p000'").select(F.struct("*").alias("l")).crossJoin(people.filter("profile_id = 'p001'").select(F.struct("*").alias("r")))
    df = pair.withColumn("score", F.lit(0.5)).withColumn("decision", F.lit("abstain")).withColumn("name_similarity", F.lit(0.9))
    df = df.withColumn("prompt", adjudication_prompt(["name_similarity"]))
    assert "name_similarity: 0.9000" in df.first()["prompt"]
    verdict = lambda backend: ask(df, "prompt", backend).select(read_reply().alias("a")).first()["a"]["verdict"]
    assert verdict(None) == "abstain"
    assert verdict(lambda p: '```json\n{"verdict": "match", "confidence": 0.8, "reasoning": "same"}\n```') == "match"
    assert verdict(lambda p: "no idea") == "abstain"
