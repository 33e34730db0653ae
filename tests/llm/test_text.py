import random

import numpy as np
import pytest

from kinweave.llm.container_packing import fill_report, pack, packed
from kinweave.llm.cut_texts import cut_documents, cut_rates, cut_scores
from kinweave.llm.label_model import LabelModel
from kinweave.llm.page_body import main_runs, parse_page
from kinweave.llm.source_mix import mix_report, mixed
from kinweave.llm.tokens import VOCABULARY, encoder

PAGE = """<html><head><title>t</title></head><body><div><a href=1>Home</a> | <a href=2>About us</a></div><table><tr><td>Login<td>Blog</tr></table>
<main><h1>{name}</h1><p>{a} &amp; <b>more</b> of it, told at some length for everyone who reads it.<p>{b} was never easy, says {name}, and nobody asked for it twice.<ul><li>maps<li>graphs</ul></main>
<!-- <p>no</p> --><script>var x='<p>no</p>'</script><footer><p>Imprint | Privacy | Terms</p><p>All rights reserved by the site.</p></footer>"""


def test_runs_are_counted_as_defined():
    _, _, _, _, runs, _ = parse_page(PAGE.format(name="Ada", a="One", b="Two"))
    assert runs == ["Home | About us", "Login", "Blog", "Ada", "One & more of it, told at some length for everyone who reads it.", "Two was never easy, says Ada, and nobody asked for it twice.", "maps", "graphs", "Imprint | Privacy | Terms", "All rights reserved by the site."]
    for broken in ("", "<", "<p", "<p><p></div></div>", "<a href='x>y", "text", "<!-- open", "<script>x", "&#x110000;"):
        parse_page(broken)


def test_main_body_is_found(spark):
    rows = [(f"g{i:03}_raw", PAGE.format(name=f"Person {i}", a=f"Topic {i}", b=f"Task {i * 7}"), None) for i in range(60)]
    rows += [("g001_raw", rows[1][1], None), ("n_raw", None, None), ("e_raw", "", None), (None, "<p>x", None), ("s_raw", "<br>", None)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id string, html string, fetched_at timestamp, run_no int")
    got = {}
    for r in main_runs(df).collect():
        got.setdefault(r["page_id"], []).append(r["run_no"])
    assert len(got) == 60 and sum(sorted(v) == [3, 4, 5, 6, 7] for v in got.values()) >= 57
    assert main_runs(df.limit(0)).count() == 0


SUBJECTS = ["The committee", "A small team", "One reviewer", "The office", "Our group", "A colleague"]
VERBS = ["praised", "collected", "measured", "questioned", "rewrote", "documented"]
OBJECTS = ["the reading list", "every example", "the oldest part of the code", "a handbook for new people", "most of the slides", "the interview archive"]
ENDS = ["without changing the interface", "before anyone asked for it", "and put the results online", "in under nine weeks", "because the old scripts had stopped working"]


def sentence():
    return f"{random.choice(SUBJECTS)} {random.choice(VERBS)} {random.choice(OBJECTS)} {random.choice(ENDS)}."


def test_cut_texts_on_held_out_cases(spark):
    random.seed(12)
    rows, cut = [], set()
    for i in range(900):
        t = " ".join(sentence() for _ in range(random.randint(3, 8)))
        if i % 10 == 0:
            t = t[: random.randint(len(t) // 3, len(t) - 8)]
            if not t.rstrip().endswith("."):
                cut.add(i)
        elif i % 10 == 1:
            t = t[:-1]
        rows.append((i, t, "en", "github"))
    rows += [(9001, None, "en", "github"), (9002, "", None, None), (9003, "  ", "xx", None), (9004, rows[3][1], "en", "github"), (9005, "ab " * 40_000 + "end.", "en", "github")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r["doc_id"] for r in cut_documents(df).collect()}
    assert len(got & cut) >= 0.9 * len(cut) and len(got - cut) <= 0.1 * len(cut)
    assert cut_scores(df).count() == len(rows) - 1
    assert {r["source"] for r in cut_rates(df).collect()} == {"github", "?"}
    assert cut_documents(df.limit(0)).count() == 0


def test_pack_respects_every_limit():
    random.seed(3)
    d = np.array([[random.randint(1, 90), 1, random.randint(0, 60)] for _ in range(400)], float)
    limit = np.array([100, 4, 70], float)
    d[:, 2] = np.minimum(d[:, 2], d[:, 0])
    b = pack(d, limit)
    assert (b >= 0).all()
    for k in range(b.max() + 1):
        assert (d[b == k].sum(0) <= limit + 1e-9).all() and (b == k).any()
    # close to the bound that the fullest dimension sets
    assert b.max() + 1 <= 1.1 * np.ceil((d.sum(0) / limit).max()) + 2
    assert len(pack(np.zeros((0, 3)), limit)) == 0


@pytest.fixture(scope="module")
def docs(spark):
    random.seed(5)
    rows = []
    for i in range(400):
        src = random.choice(["a", "a", "a", "b", "c"])
        words = {"a": "maps and graphs", "b": "cats or dogs", "c": "tea with milk"}[src]
        rows.append((i, " ".join(random.choice(words.split() + ["the", "of"]) for _ in range(random.randint(1, 90))), src))
    rows += [(1000, None, "a"), (1001, "", "a"), (1002, "word " * 3000, "a"), (1003, "x", None), (1004, "y z", "other"), (1005, rows[0][1], "a")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_packing_places_every_text_once(spark, docs):
    kinds = spark.createDataFrame([("s", 128), ("l", 1024), ("none", None), ("zero", 0), ("s", 128)], "container_kind string, capacity_tokens int")
    p = packed(docs, kinds, group=100).collect()
    enc = encoder(VOCABULARY)
    size = {r["doc_id"]: len(enc.encode_ordinary(r["text"])) for r in docs.collect() if r["text"]}
    for kind, cap in (("s", 128), ("l", 1024)):
        mine = [r for r in p if r["container_kind"] == kind]
        total = {}
        for r in mine:
            total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["n_tokens"]
        assert total == size
        assert {r["doc_id"] for r in mine if r["piece"] > 0} == {i for i, n in size.items() if n > cap}
        load = {}
        for r in mine:
            load[r["container_id"]] = load.get(r["container_id"], 0) + r["n_tokens"]
        assert max(load.values()) <= cap
    assert {r["container_kind"] for r in p} == {"s", "l"}
    assert min(r["fill"] for r in fill_report(packed(docs, kinds)).collect()) > 0.9
    assert packed(docs.limit(0), kinds).count() == 0


def test_mix_meets_shares_within_repeats(spark, docs):
    targets = spark.createDataFrame([("a", 0.4, 1), ("b", 0.35, 3), ("c", 0.25, 3), ("gone", 0.2, 1), (None, 0.1, 1), ("zero", 0.0, 2)], "source string, target_share double, max_repeats int")
    mix, report = mixed(docs, targets)
    rows = mix.collect()
    assert len(rows) == docs.filter("text <> ''").count()
    most = {"a": 1, "b": 3, "c": 3}
    assert all(0 <= r["repeats"] <= most.get(r["source"], 0) for r in rows)
    shares = {r["source"]: r["share"] for r in mix_report(mix, targets).collect()}
    for s, want in (("a", 0.4), ("b", 0.35), ("c", 0.25)):
        assert abs(shares[s] - want) < 0.03
    assert shares["gone"] == 0.0 and report["residuals"][-1] <= report["residuals"][0] + 1e-9
    assert mixed(docs.limit(0), targets)[0].count() == 0
    assert mixed(docs, targets.limit(0))[0].count() == 0


def test_label_model_learns_accuracies():
    rng = np.random.default_rng(1)
    y = rng.random(20_000) < 0.3
    votes = np.stack([np.where(rng.random(20_000) < acc, y, ~y).astype(int) for acc in (0.9, 0.8, 0.7)], 1)
    votes = np.c_[votes, votes[:, 2]]  # a copy: fully dependent
    patterns, inv, n = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    p = LabelModel([2] * 4, [[0.5, 2]] * 4).fit(patterns, n.astype(float))
    guess = p[inv.ravel()] >= 0.5
    assert (guess == y).mean() > 0.88
    assert len(LabelModel([2], [[0.5, 2]]).fit(np.zeros((0, 1), int), np.zeros(0))) == 0


def test_long_runs_are_weighed_whole():
    from kinweave.llm.page_body import _word_ids

    assert len(_word_ids("word " * 1000 + "end", {})) == 1001
