import random

from kinweave.llm.forest_split import SPLITS, boruvka_forest, deal_roots, grouped_splits, split_breaches
from kinweave.llm.grid_components import decided_links, grid_components


def smallest(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {v: find(v) for v in list(parent)}


def test_grid_against_union_find(spark):
    random.seed(4)
    ids = [f"v{i:03}" for i in range(150)]
    edges = [(random.choice(ids), random.choice(ids)) for _ in range(110)] + [("hub", i) for i in ids[:40]] + [(f"c{i:02}", f"c{i + 1:02}") for i in range(30)] + [("v001", None), ("v002", "v002"), ("v003", "v004"), ("v004", "v003")]
    df = spark.createDataFrame([(*e, "x") for e in edges], "u string, v string, group_id string")
    for cell in (10, 40, 100_000):  # many cells, some, one
        got = {r["vertex"]: r["group_id"] for r in grid_components(df, cell_edges=cell).collect()}
        assert got == smallest(edges)
    assert grid_components(df.limit(0)).count() == 0


def test_latest_decision_speaks(spark):
    import datetime as dt

    t = lambda d: dt.datetime(2024, 1, d)
    rows = [("a", "b", "match", t(1)), ("b", "a", "non_match", t(2)), ("c", "d", " MATCH ", t(1)), ("c", "d", None, None), ("e", "f", "match", t(1)), ("f", "e", None, t(3)), ("g", "g", "match", t(1)), ("h", None, "match", t(1)), ("i", "j", "match", t(1)), ("i", "j", "match", t(1))]
    df = spark.createDataFrame(rows, "left_profile_id string, right_profile_id string, decision string, resolved_at timestamp")
    assert {(r["u"], r["v"]) for r in decided_links(df).collect()} == {("c", "d"), ("i", "j")}


def test_forest_spans_and_has_no_cycle(spark):
    random.seed(7)
    ids = [f"n{i:02}" for i in range(40)]
    edges = [(random.choice(ids), random.choice(ids), float(random.randint(1, 3))) for _ in range(70)] + [("n01", None, 1.0), ("n02", "n03", None)]
    df = spark.createDataFrame(edges, "u string, v string, w double")
    member, forest = boruvka_forest(df)
    want = smallest([(a, b) for a, b, _ in edges])
    root = {r["node"]: r["root"] for r in member.collect()}
    assert set(root) == set(want)
    groups = {}
    for v, g in want.items():
        groups.setdefault(g, set()).add(root[v])
    assert all(len(x) == 1 for x in groups.values()) and len({min(x) for x in groups.values()}) == len(groups)
    assert forest.count() == len(want) - len(groups)
    # the weight is that of Kruskal's forest
    parent = {v: v for v in want}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    total = 0.0
    for w, a, b in sorted((w if w is not None else float("inf"), a, b) for a, b, w in edges if a != b and b is not None):
        if find(a) != find(b):
            parent[find(a)] = find(b)
            total += w if w != float("inf") else 0
    assert sum(r["w"] for r in forest.collect() if r["w"] != float("inf")) == total
    assert boruvka_forest(df.limit(0))[0].count() == 0


def test_dealing_meets_shares_and_places_giants(spark):
    sizes = spark.createDataFrame([("giant", 5000)] + [(f"r{i}", 1 + i % 7) for i in range(2500)], "root string, n long")
    dealt = deal_roots(sizes).join(sizes, "root")
    total = {r["split"]: r["s"] for r in dealt.groupBy("split").agg({"n": "sum"}).withColumnRenamed("sum(n)", "s").collect()}
    assert dealt.count() == 2501 and dealt.select("root").distinct().count() == 2501
    for s, p in SPLITS:
        assert abs(total[s] / sum(total.values()) - p) < 0.02
    assert deal_roots(sizes.limit(0)).count() == 0


def test_persons_stay_together(spark, make_profiles):
    p = make_profiles([{"canonical_person_id": c} for c in ("ann_x", "ann_x", "bob_y", None, None)])
    e = spark.createDataFrame(
        [("p000", "p001", "Ann-X", "train"), ("p001", "p002", "ann_x", "test"), ("p002", "p003", "bob_y", "train"), ("p002", "p003", "bob_y", None), ("p003", "p004", "unknown", "train"), ("p003", "p004", "unknown", "test")],
        "left_profile_id string, right_profile_id string, left_canonical_id string, split string",
    )
    rows = grouped_splits(p, e)
    assert rows.count() == 11
    for key in ("person", "profile_id"):
        assert rows.filter(f"{key} is not null").groupBy(key).agg({"split": "collect_set"}).filter("size(`collect_set(split)`) > 1").count() == 0
    assert [r[0] for r in split_breaches(p, e).collect()] == ["ann_x"]
    assert split_breaches(p.limit(0), e.limit(0)).count() == 0
