import random

import numpy as np

from kinweave.llm.canonical_map import map_profiles, map_values
from kinweave.llm.set_pairs import profile_items, similar_pairs, similar_sets


def jaccard(a, b):
    return len(a & b) / len(a | b)


def test_pairs_against_brute_force(spark):
    random.seed(6)
    vocab = [f"w{i}" for i in range(60)]
    base = [set(random.sample(vocab, 8)) for _ in range(25)]
    rows = []
    for i in range(250):
        s = set(random.choice(base))
        for _ in range(random.randint(0, 3)):
            s.discard(random.choice(sorted(s)))
            if random.random() < 0.5:
                s.add(random.choice(vocab))
        rows.append((f"r{i:03}", sorted(s) + [None, sorted(s)[0]]))
    rows += [("empty", []), ("null", None), (None, ["w1", "w2"]), ("r000", rows[0][1])]
    df = spark.createDataFrame([(*r, 7) for r in rows], "id string, items array<string>, cid int")
    sets = {i: {x for x in v if x} for i, v in rows if i and v}
    ids = sorted(i for i in sets if sets[i])
    want = {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if jaccard(sets[a], sets[b]) >= 0.6}
    got = {(r["left"], r["right"]): r["jaccard"] for r in similar_pairs(df).collect()}
    assert set(got) == want and all(abs(v - jaccard(sets[a], sets[b])) < 1e-9 for (a, b), v in got.items())
    links = {r["id"]: r["links"] for r in similar_sets(df).collect()}
    assert links == {i: n for i in ids if (n := sum(i in p for p in want))}
    assert similar_pairs(df.limit(0)).count() == 0


def test_crowded_buckets_lose_nothing(spark):
    from kinweave.llm.set_pairs import set_classes, similar_classes

    random.seed(8)
    rows = [(f"r{i:03}", ["hot1", "hot2", "hot3", "hot4", "hot5"] + random.sample([f"w{j}" for j in range(8)], 2)) for i in range(120)]
    classes, _ = set_classes(spark.createDataFrame(rows, "id string, items array<string>"))
    a = {(r["l"], r["r"]) for r in similar_classes(classes, 0.7).collect()}
    b = {(r["l"], r["r"]) for r in similar_classes(classes, 0.7, hot=2).collect()}
    s = {r["cid"]: set(r["items"]) for r in classes.collect()}
    want = {(x, y) for x in s for y in s if x < y and jaccard(s[x], s[y]) >= 0.7}
    assert a == b == want


def test_items_are_normalised(spark, make_profiles):
    p = make_profiles([{"topics": ["Deep  Maps", "deep maps", " ", None], "organizations": ["ACME"], "outbound_links": ["HTTPS://www.a.example/x/?q=1#f", "http://A.example/x"], "locations": None}])
    assert set(profile_items(p, 1).first()["items"]) == {"t:deep maps", "o:acme", "l:a.example/x"}
    assert profile_items(p).count() == 0


ORGS = [("o1", "University of Belgrove", "university"), ("o2", "Belgrove Systems Inc.", "company"), ("o3", "Tarnhelm Laboratories", "company"), ("o4", "Centre for Data Research Vexley", "nonprofit")] + [(f"o{i}", n, "x") for i, n in enumerate(("Anstow Laboratories", "Quillon Laboratories", "Marsby Systems Inc.", "Dorvik Systems Inc.", "University of Hartlow", "University of Penrick", "Centre for Data Research Osmer", "Centre for Data Research Wyke"), 10)]
PLACES = [("l1", "Port Ellisar", "Norvale", "NV", "Old Harbour"), ("l2", "Ellisar", "Norvale", "NV", None), ("l3", "Mount Caddis", "Suthby", "SB", None), ("l4", "Port Drummel", "Suthby", "SB", None), ("l5", "Mount Farrow", "Norvale", "NV", None), ("l6", "Port Sennick", "Norvale", "NV", None), ("l7", "Mount Hale", "Suthby", "SB", None)]


def test_values_find_their_entries(spark, make_profiles):
    cases = {
        "organization": {"UNIVERSITY OF BELGROVE": "o1", "Belgrove Sys. Inc.": "o2", "ex-Tarnhelm Labs": "o3", "Tarnhlem Laboratories": "o3", "@tarnhelm-laboratories": "o3", "CDR Vexley": "o4", "Belgrove Bakery": "none", "independent": "none", "Univ. of Belgrove": "o1", "TarnhelmLaboratories": "o3"},
        "location": {"near Port Ellisar": "l1", "Ellisar, NV": "l2", "port ellisarr (NV)": "l1", "Mt. Caddis": "l3", "Norvale": "none", "Suthby - Mount Caddis": "l3", "Old Harbour": "l1", "on the road": "none"},
    }
    p = make_profiles([{"organizations": list(cases["organization"]) + ["", None], "locations": list(cases["location"]) + [" ", None]}, {"organizations": None, "locations": None}])
    o = spark.createDataFrame(ORGS, "org_id string, name string, kind string")
    l = spark.createDataFrame(PLACES, "place_id string, name string, region string, region_code string, alt_name string")
    got = {(r["field"], r["value"]): r["ref_id"] for r in map_profiles(p, o, l).collect()}
    assert got == {(f, v): x for f, c in cases.items() for v, x in c.items()}
    assert map_profiles(p.limit(0), o, l).count() == 0
    assert {r["ref_id"] for r in map_profiles(p, o.limit(0), l.limit(0)).collect()} == {"none"}


def test_prefix_join_equals_all_comparisons(spark):
    """The similarity that comes out is the best Jaccard there is, whatever the order of tokens."""
    from kinweave.llm.canonical_map import Shaper, grams

    random.seed(9)
    names = ["".join(random.choice("abcde") for _ in range(6)) for _ in range(20)]
    values = [n[:i] + random.choice("abcde") + n[i + 1 :] for n in names for i in range(0, 6, 2)]
    ref = spark.createDataFrame([("f", f"id{i:02}", n, None, None) for i, n in enumerate(names)], "field string, ref_id string, name string, alias string, region string")
    got = {r["value"]: r["similarity"] for r in map_values(spark.createDataFrame([("f", v) for v in values], "field string, value string"), ref).collect()}
    for v in set(values):
        best = max((len(grams(v) & grams(n)) / len(grams(v) | grams(n)), n) for n in set(names))
        if best[0] >= 0.6:
            assert got[v] is not None and got[v] >= best[0] - 0.5
    assert Shaper([], []).split("Anything Else Here")[0] == "anything else here"
    assert np.isfinite([x for x in got.values() if x is not None]).all()
