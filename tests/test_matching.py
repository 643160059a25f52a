"""Random geometries and graphs against plain definitions."""

from itertools import combinations

import numpy as np
import plain
import pytest

import catweave as cw
from catweave.operators.dedupe import dedupe_survey
from catweave.operators.edges import edges_from_frames
from catweave.operators.resolvers import sequential_component, split_component


def line(*arcsec, ra=77.0, dec=31.0):
    """Positions one above the other, so far from the first."""
    return [ra] * len(arcsec), [dec + o / 3600 for o in arcsec]


def field(seed, sizes, spots=12, jitter=0.45):
    """Catalogues of rows around shared spots on a small field."""
    rng = np.random.default_rng(seed)
    centre = rng.uniform(0, 60, (spots, 2))
    out = {}
    for n, size in sizes.items():
        at = centre[rng.integers(0, spots, size)] + rng.normal(0, jitter, (size, 2))
        out[n] = ([211.5 + x / 3600 / np.cos(np.radians(-12.0)) for x in at[:, 0]], [-12.0 + y / 3600 for y in at[:, 1]])
    return out


def places(c):
    return list(zip(*c))


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda t: tuple((x is None, x) for x in t))


def got_list(rows):
    return sorted(map(tuple, rows), key=lambda t: tuple((x is None, x) for x in t))


def made(spark, counts, pairs, disputed=None, dropped=None):
    """Edges from rows and pair lists."""
    names = sorted(counts)
    settings = cw.edge_settings(names, radius_arcsec=1.0, dedupe_radius_arcsec=0.0)
    rows = spark.createDataFrame([(n, i) for n in names for i in range(counts[n])], "survey string, row long")
    out = [(n, r, "disputed", None) for n, rs in (disputed or {}).items() for r in rs]
    outcomes = spark.createDataFrame(out, "survey string, row long, status string, kept_row long")
    e = [(p[0], p[1], i, j, s) for p, (a, b, sep) in pairs.items() for i, j, s in zip(a, b, sep)]
    return edges_from_frames(spark, rows, outcomes, spark.createDataFrame(e, "survey_a string, survey_b string, row_a long, row_b long, separation_arcsec double"), settings)


@pytest.mark.parametrize("policy", ["anchored_nearest", "anchored_unique", "mutual_nearest", "mutual_unique"])
def test_policies(spark, policy):
    rng = np.random.default_rng(21)
    found = {(int(i), int(j)): float(s) for i, j, s in zip(rng.integers(0, 25, 60), rng.integers(0, 25, 60), rng.integers(1, 6, 60) / 8)}  # with ties
    pairs = spark.createDataFrame([(i, j, s) for (i, j), s in found.items()], "row_a long, row_b long, separation_arcsec double")
    assert got(cw.one_to_one_pairs(pairs, policy)) == sorted((i, j, s) for (i, j), s in plain.policy(found, policy).items())
    with pytest.raises(ValueError, match="none of the pair policies"):
        cw.one_to_one_pairs(pairs, "farthest")


@pytest.mark.parametrize("r", [0.5, 1.0, 5.0])
def test_pairs_equal_brute_force(spark, r):
    rng = np.random.default_rng(5)
    a, b = (np.column_stack([150 + rng.uniform(0, 0.05, n), rng.uniform(0, 0.05, n)]) for n in (400, 300))
    xyz = [np.column_stack([np.cos(np.radians(m[:, 1])) * np.cos(np.radians(m[:, 0])), np.cos(np.radians(m[:, 1])) * np.sin(np.radians(m[:, 0])), np.sin(np.radians(m[:, 1]))]) for m in (a, b)]
    d2 = ((xyz[0][:, None] - xyz[1][None]) ** 2).sum(2)
    want = sorted(zip(*np.where(d2 <= cw.arcsec_to_chord(r) ** 2)))
    fa, fb = cw.catalogue(spark, (a[:, 0], a[:, 1])), cw.catalogue(spark, (b[:, 0], b[:, 1]))
    found = cw.all_pairs(fa, fb, r)
    assert got(found.select("row_a", "row_b")) == want
    nearest = {}
    for i, j in want:
        nearest.setdefault(i, []).append((d2[i, j], j))
    assert got(cw.all_pairs(fa, fb, r, k=1).select("row_a", "row_b")) == sorted((i, min(v)[1]) for i, v in nearest.items())
    own = ((xyz[0][:, None] - xyz[0][None]) ** 2).sum(2)
    assert got(cw.self_pairs(fa, r).select("row_a", "row_b")) == [(i, j) for i, j in sorted(zip(*np.where(own <= cw.arcsec_to_chord(r) ** 2))) if i < j]


def test_geometry_edges(spark):
    one = lambda *p: cw.catalogue(spark, ([x for x, _ in p], [y for _, y in p]))
    near = lambda p, q, r: cw.all_pairs(one(p), one(q), r).count()
    # Over the meridian, over a pole, to the far side, and at one place.
    for p, q in (((359.9999, -35.0), (0.0001, -35.0)), ((20.0, 89.99995), (200.0, 89.99995)), ((64.0, -89.9999), (334.0, -89.9999)), ((5.0, 5.0), (185.0, -5.0)), ((301.0, 44.0), (301.0, 44.0))):
        s = plain.separation(p, q)
        assert near(p, q, s * (1 + 1e-6) + 1e-6) == 1 and (s < 1e-6 or near(p, q, min(s, 7200.0) * (1 - 1e-6)) == 0)
    assert got(cw.all_pairs(one((-33.0, 90.0), (400.0, -90.0)), one((7.0, -90.0), (700.0, 90.0)), 2.0).select("row_a", "row_b")) == [(0, 1), (1, 0)]
    for bad in (0.0, -1.0, float("nan"), float("inf")):
        with pytest.raises(ValueError):
            near((0.0, 0.0), (0.0, 0.0), bad)
    for r in (0.3, 2.0, 17.0):
        for step, n in ((-2e-4, 1), (2e-4, 0)):
            assert cw.all_pairs(cw.catalogue(spark, line(0)), cw.catalogue(spark, line(r + step)), r).count() == n


@pytest.mark.parametrize("seed", range(3))
def test_dedupe(spark, seed):
    c = field(seed, {"a": 45}, spots=16)["a"]
    found = plain.dedupe(places(c), 0.7)
    assert {s for s, _ in found.values()} == {"dropped", "disputed"}
    assert got(dedupe_survey(cw.catalogue(spark, c), 0.7)) == got_list((r, *v) for r, v in found.items())
    assert dedupe_survey(cw.catalogue(spark, c), 0.0).count() == 0


def graph(seed, counts, share=0.4, disputed=()):
    """Random links between surveys: ``{(survey, survey): (rows, rows, separations)}`` and the same as pairs of nodes."""
    rng = np.random.default_rng(seed)
    names, pairs, link = sorted(counts), {}, {}
    for a, b in combinations(names, 2):
        found = [(i, j, round(float(rng.random()), 3)) for i in range(counts[a]) for j in range(counts[b]) if i // 3 == j // 3 and rng.random() < share and (a, i) not in disputed and (b, j) not in disputed]
        pairs[a, b] = tuple(map(list, zip(*found))) if found else ([], [], [])
        link |= {frozenset(((names.index(a), i), (names.index(b), j))): s for i, j, s in found}
    return pairs, link


@pytest.mark.parametrize("policy", ["mutual_nearest", "mutual_unique"])
def test_degenerate(spark, policy):
    counts = {"p": 9, "q": 9, "r": 9}
    pairs, _ = graph(31, counts, 0.5)
    kept = {k: plain.policy({(i, j): s for i, j, s in zip(*v)}, policy) for k, v in pairs.items()}
    want = sorted((i, j, k) for i, j in kept["p", "q"] for x, k in kept["p", "r"] if x == i and (j, k) in kept["q", "r"])
    index = cw.resolve(made(spark, counts, pairs), cw.DegenerateCrossmatchConfig(("p", "q", "r"), policy))
    assert [r[:3] for r in got(index.df)] == want and index.summary["n_groups"] == len(want) and index.summary["policy"] == policy
    assert index.df.columns == ["p/row_index", "q/row_index", "r/row_index", "p+q/separation_arcsec", "p+r/separation_arcsec", "q+r/separation_arcsec"]
    with pytest.raises(ValueError, match="one survey at one other"):
        cw.DegenerateCrossmatchConfig(("p", "q", "r"), "anchored_nearest")


A = "ambiguous_component"
MODES = [
    ({}, {}), ({"disputed": "drop"}, {"drop": True}), ({"resolver": "split"}, {"resolver": "split"}), ({"resolver": "split", "size_cap": 4}, {"resolver": "split", "size_cap": 4}),
    ({"resolver": "sequential"}, {"resolver": "sequential"}), ({"resolver": "sequential", "priority": ("r", "p", "q")}, {"resolver": "sequential", "priority": ("r", "p", "q")}),
    ({"selection": cw.EntitySelectionConfig(2)}, {"least": 2}), ({"resolver": "split", "selection": cw.EntitySelectionConfig(2, ("r",))}, {"resolver": "split", "least": 2, "include": ("r",)}),
]


@pytest.mark.parametrize("mode, rules", MODES)
def test_entitywise(spark, mode, rules):
    counts, disputed = {"p": 14, "q": 12, "r": 13}, {"p": [2, 7], "r": [4]}
    pairs, link = graph(9, counts, 0.3, {(n, r) for n, rows in disputed.items() for r in rows})
    edges = made(spark, counts, pairs, disputed)
    index = cw.resolve(edges, cw.EntitywiseCrossmatchConfig(**mode))
    want = plain.entities(counts, link, disputed, **rules)
    assert got(index.df) == want
    order = [tuple(r) for r in index.ordered().collect()]
    assert order == sorted(want, key=lambda t: next((k, x) for k, x in enumerate(t[:3]) if x is not None))
    refused = plain.entities(counts, link, disputed)
    facts = index.summary
    assert facts["n_entities"] == len(want) and facts["n_dedupe_disputed_rows"] == 3
    assert facts["rows_in_ambiguous_components"] == sum(r[-1] == A for r in refused) > 0
    assert facts["n_clean_multi_survey"] == sum(sum(x is not None for x in r[:3]) > 1 for r in refused) > 0
    assert facts["n_clean_components"] == sum(r[-1] is None for r in refused)
    nodes = [(s, r) for s, n in enumerate("pqr") for r in range(counts[n]) if r not in disputed.get(n, [])]
    assert facts["n_ambiguous_components"] == sum(not plain.complete(g, link) for g in plain.components(nodes, [tuple(sorted(p)) for p in link]))
    if "selection" in mode:
        assert facts["n_entities_before_selection"] == len(plain.entities(counts, link, disputed, rules.get("resolver", "refuse")))


def test_resolvers_equal_plain_search():
    rng = np.random.default_rng(9)
    for k in range(120):
        size = int(rng.integers(1, 5))
        nodes = [(s, r) for s in range(3) for r in range(size)]
        link = {frozenset((m, n)): float(rng.integers(1, 9)) / 8 if k % 2 else float(rng.random()) for i, m in enumerate(nodes) for n in nodes[i + 1 :] if m[0] != n[0] and rng.random() < 0.6}
        for found, want in ((split_component(nodes, link), plain.split(nodes, link)), (sequential_component(nodes, link, [2, 0, 1]), plain.sequential(nodes, link, [2, 0, 1]))):
            assert {tuple(sorted(g)) for g in found} == want and sorted(n for g in found for n in g) == nodes


THREE = field(5, {"a": 30, "b": 26, "c": 22})
SETTINGS = {"radius_arcsec": 0.9, "dedupe_radius_arcsec": 0.25, "dedupe_radius_arcsec_overrides": {"c": 0.0}, "radius_arcsec_overrides": {("a", "c"): 0.6}}
RADII = {("a", "b"): 0.9, ("a", "c"): 0.6, ("b", "c"): 0.9}


def test_build_and_audit(spark):
    e = cw.build_edges(spark, THREE, **SETTINGS)
    found = {n: plain.dedupe(places(c), 0.0 if n == "c" else 0.25) for n, c in THREE.items()}
    assert got(e.outcomes) == got_list((n, r, *v) for n, d in found.items() for r, v in d.items())
    want = {k: {(i, j): s for (i, j), s in plain.pairs(places(THREE[k[0]]), places(THREE[k[1]]), r).items() if i not in found[k[0]] and j not in found[k[1]]} for k, r in RADII.items()}
    for (a, b), pairs in want.items():
        assert got(e.pair(a, b).select("row_a", "row_b")) == sorted(pairs)
        assert got(e.pair(b, a).select("row_a", "row_b")) == sorted((j, i) for i, j in pairs)
    audit = cw.audit_edges(e)
    assert audit["all_pairs_built"]
    for survey in audit["surveys"]:
        own = found[survey["name"]]
        kept = [k for s, k in own.values() if s == "dropped"]
        assert survey["n_dropped"] == len(kept) and survey["n_disputed"] == len(own) - len(kept) and survey["n_active"] == survey["n_rows"] - len(own)
        assert survey["n_duplicate_groups"] == len(set(kept)) and survey["largest_duplicate_group"] == max((kept.count(k) + 1 for k in kept), default=0)
    for pair in audit["pairs"]:
        own = want[tuple(pair["surveys"])]
        assert pair["n_edges"] == len(own) and pair["separation_arcsec"]["p50"] == pytest.approx(np.percentile(list(own.values()), 50), abs=1e-4)
        for side, n in enumerate(pair["surveys"]):
            rows = [k[side] for k in own]
            active = len(THREE[n][0]) - len(found[n])
            assert pair["matched_row_fraction"][n] == round(len(set(rows)) / active, 6) and pair["multi_candidate_rows"][n] == sum(rows.count(r) > 1 for r in set(rows))
    link = {frozenset((("abc".index(a), i), ("abc".index(b), j))) for (a, b), own in want.items() for i, j in own}
    nodes = [(s, r) for s, n in enumerate("abc") for r in range(len(THREE[n][0])) if r not in found[n]]
    groups, c = plain.components(nodes, [tuple(sorted(p)) for p in link]), audit["components"]
    assert (c["n_rows"], c["n_components"], c["max_size"]) == (len(nodes), len(groups), max(map(len, groups)))
    assert c["n_ambiguous"] == sum(not plain.complete(g, link) for g in groups) > 0
    assert c["size_histogram"]["2"] == sum(len(g) == 2 for g in groups) and c["size_histogram"][">=6"] == sum(len(g) > 5 for g in groups)
    combos = {}
    for g in groups:
        if len(g) > 1:
            one = combos.setdefault("+".join("abc"[s] for s in sorted({s for s, _ in g})), {"n_components": 0, "n_clean": 0})
            one["n_components"] += 1
            one["n_clean"] += plain.complete(g, link)
    assert c["by_survey_combination"] == combos
    empty = cw.audit_edges(cw.build_edges(spark, {"a": ([], []), "b": ([], [])}, radius_arcsec=1.0, dedupe_radius_arcsec=0.0))
    assert empty["components"] == {"n_rows": 0, "n_components": 0} and empty["pairs"][0]["separation_arcsec"] is None


def test_crossmatch(spark):
    run = lambda c, mode=None, **k: got(cw.crossmatch(spark, c, **{"radius_arcsec": 1.5, "dedupe_radius_arcsec": 0.0, **k}, mode=mode or cw.EntitywiseCrossmatchConfig()).df)
    chain = {"p": line(0), "q": line(0.7), "r": line(1.4)}
    assert run(chain) == [(0, 0, 0, None)]
    assert run(chain, radius_arcsec_overrides={("p", "r"): 1.2}) == [(0, None, None, A), (None, 0, None, A), (None, None, 0, A)]
    assert run({"p": ([], []), "q": line(3, 9)}) == [(None, 0, None), (None, 1, None)]
    assert run({"p": line(5, 5.2, 60), "q": line(5.1)}, dedupe_radius_arcsec_overrides={"p": 0.5}) == [(0, 0, None), (2, None, None)]
    found = plain.pairs(places(THREE["a"]), places(THREE["b"]), 0.9)
    for p in ("anchored_nearest", "anchored_unique", "mutual_nearest", "mutual_unique"):
        index = cw.crossmatch(spark, {n: THREE[n] for n in "ab"}, radius_arcsec=0.9, dedupe_radius_arcsec=0.0, mode=cw.DegenerateCrossmatchConfig(("a", "b"), p))
        assert [r[:2] for r in got(index.df)] == sorted(plain.policy(found, p))


@pytest.mark.parametrize("change", [{"radius_arcsec": 0}, {"dedupe_radius_arcsec": -1}, {"dedupe_radius_arcsec_overrides": {"x": 1}}, {"radius_arcsec_overrides": {("a", "a"): 1}}, {"radius_arcsec_overrides": {("a", "b"): 1, ("b", "a"): 2}}, {"pairs": "ab"}, {"pairs": [("a", "z")]}])
def test_bad_settings(change):
    with pytest.raises(ValueError):
        cw.edge_settings(["a", "b"], **{"radius_arcsec": 1.0, "dedupe_radius_arcsec": 0.0, **change})


def test_bad_inputs(spark):
    for names in (["a/b"], ["a+b"], [""], []):
        with pytest.raises(ValueError):
            cw.edge_settings(names, radius_arcsec=1.0, dedupe_radius_arcsec=0.0)
    for ra, dec in (([float("nan")], [0.0]), ([0.0], [91.0])):
        with pytest.raises(ValueError):
            cw.build_edges(spark, {"a": (ra, dec), "b": line(0)}, radius_arcsec=1.0, dedupe_radius_arcsec=0.0)
    with pytest.warns(UserWarning):
        cw.catalogue(spark, (np.zeros(1, np.float32), np.zeros(1)))
    with pytest.raises(ValueError):
        cw.EntitywiseCrossmatchConfig(priority=("a",))
    with pytest.raises(ValueError):
        cw.resolve(cw.build_edges(spark, THREE, **SETTINGS), cw.EntitywiseCrossmatchConfig(selection=cw.EntitySelectionConfig(4)))


def joined(u, join, anchor):
    """Rows of all sources by identifier, in the anchor's order and then the others'."""
    names = sorted(u)
    at = {n: {v: i for i, v in enumerate(vs)} for n, vs in u.items()}
    keys = dict.fromkeys([*u[anchor], *(v for n in names for v in u[n])])
    rows = [tuple(at[n].get(v) for n in names) for v in keys]
    keep = {"inner": lambda r: None not in r, "left": lambda r: r[names.index(anchor)] is not None, "outer": lambda r: True}[join]
    return [(k, *r) for k, r in enumerate(filter(keep, rows))]


@pytest.mark.parametrize("join", ["inner", "left", "outer"])
def test_uids(spark, join):
    rng = np.random.default_rng(3)
    top, half = 2**64, 2**63
    strings = ["", " ", "a", "A", "á", "007", "7", "x y", "x  y", "日本"]
    wide = [0, 1, half - 2, half - 1, half, half + 3, top - 5, top - 1, 2**53 + 7, 2**53 + 8, 17]
    signed = [-half, -half + 1, -9, 0, 1, 17, half - 2, half - 1, 2**53 + 7, 2**53 + 8]
    sources = [
        {n: rng.permutation(30)[: rng.integers(0, 25)].tolist() for n in "uvw"},
        {n: rng.permutation(np.array(strings, dtype=object))[: rng.integers(3, 10)].tolist() for n in "uvw"},
        {"u": rng.permutation(np.array(wide, dtype=object)).tolist(), "v": rng.permutation(np.array(signed, dtype=object)).tolist()},
        {"u": [], "v": ["only"]},
    ]
    for u in sources:
        for anchor in u:
            assert [tuple(r) for r in cw.match_uids(spark, u, join=join, anchor=anchor).ordered().collect()] == joined(u, join, anchor)


def test_bad_uids(spark):
    for bad in ({"u": [6, 6], "v": [6]}, {"u": [6, None], "v": [6]}, {"u": [6], "v": ["6"]}, {"u": [0.25], "v": [6]}, {"u": [False], "v": [6]}, {"u": [-3, 2**63 + 1], "v": [6]}, {"u": [6]}):
        with pytest.raises(ValueError):
            cw.match_uids(spark, bad)
    for k in ({"join": "cross"}, {"anchor": "z"}):
        with pytest.raises(ValueError):
            cw.match_uids(spark, {"u": [1], "v": [1]}, **k)


@pytest.mark.parametrize("policy", ["anchored_nearest", "mutual_nearest"])
def test_hub(spark, policy):
    rng = np.random.default_rng(12)
    c = field(7, {"h": 40, "sky": 35, "star": 30}, spots=20)
    ids = rng.permutation(500)[:40].tolist()
    other = rng.permutation([*ids[:28], *range(600, 610)]).tolist()
    links = {"star": cw.SpatialLink(1.1), "name": cw.UIDLink(), "sky": cw.SpatialLink(0.8, policy)}
    index = cw.match_hub_and_spoke(spark, anchor="h", links=links, coordinates=c, uids={"h": ids, "name": other}, dedupe_radius_arcsec=0.2, dedupe_radius_arcsec_overrides={"star": 0.0})
    gone = {n: plain.dedupe(places(c[n]), 0.0 if n == "star" else 0.2) for n in c}
    assert gone["h"] and gone["sky"]
    kept = {n: plain.policy({(i, j): s for (i, j), s in plain.pairs(places(c["h"]), places(c[n]), links[n].radius_arcsec).items() if i not in gone["h"] and j not in gone[n]}, links[n].policy) for n in ("star", "sky")}
    by_name = {i: other.index(v) for i, v in enumerate(ids) if v in other}
    want = [(i, dict(kept["star"])[i], by_name[i], dict(kept["sky"])[i]) for kept in [{n: list(p) for n, p in kept.items()}] for i in range(40) if i in dict(kept["star"]) and i in by_name and i in dict(kept["sky"])]
    assert want and index.df.columns == ["entity_id", "h/row_index", "star/row_index", "name/row_index", "sky/row_index"]
    assert [tuple(r) for r in index.ordered().collect()] == [(k, *r) for k, r in enumerate(want)]
    facts = {p["survey"]: p for p in index.summary["links"]}
    assert {n: p["n_matches"] for n, p in facts.items()} == {"star": len(kept["star"]), "name": len(by_name), "sky": len(kept["sky"])} and index.summary["n_rows"] == len(want)
    dropped = lambda n: sum(s == "dropped" for s, _ in gone[n].values())
    assert facts["sky"]["dedupe"]["h"] == {"radius_arcsec": 0.2, "n_covered": 40, "n_dropped": dropped("h"), "n_disputed": len(gone["h"]) - dropped("h")}
    assert facts["star"]["resolved_config"]["surveys"][1] == {"name": "star", "dedupe_radius_arcsec": 0.0} and facts["name"]["resolved_config"]["join"] == "inner"


def test_bad_hubs(spark):
    sky, uid = cw.SpatialLink(1.0), cw.UIDLink()
    run = lambda links, coordinates=None, uids=None, **k: cw.match_hub_and_spoke(spark, anchor="h", links=links, coordinates=coordinates, uids=uids, **{"dedupe_radius_arcsec": 0.0, **k})
    for links, coordinates, uids in (
        ({}, {}, {}), ({"h": uid}, {}, {"h": [1]}), ({"z": sky}, {"h": line(0)}, {}), ({"z": "sky"}, {"h": line(0), "z": line(0)}, {}),
        ({"z": sky}, {"h": line(0), "z": line(0), "y": line(0)}, {}), ({"z": uid}, {"h": line(0)}, {"h": [1], "z": [1]}), ({"z": sky}, {"h": line(0), "z": line(0)}, {"h": [1]}),
    ):
        with pytest.raises(ValueError):
            run(links, coordinates, uids)
    with pytest.raises(ValueError, match="2 positions but 3 identifiers"):
        run({"y": sky, "z": uid}, {"h": line(0, 9), "y": line(0)}, {"h": [1, 2, 3], "z": [1]})
    with pytest.raises(ValueError, match="need dedupe_radius"):
        run({"z": sky}, {"h": line(0), "z": line(0)}, dedupe_radius_arcsec=None)
    with pytest.raises(ValueError):
        cw.SpatialLink(0.0)


def test_ids(spark):
    index = cw.crossmatch(spark, {"p": line(0, 40), "q": line(0.3)}, radius_arcsec=1.0, dedupe_radius_arcsec=0.0, mode=cw.EntitywiseCrossmatchConfig())
    ids = {"p": spark.createDataFrame([(0, "one"), (1, "two")], "row long, id string"), "q": spark.createDataFrame([(0, 88)], "row long, id long")}
    named = cw.rows_to_ids(index, ids, id_columns={"p": "name"})
    assert named.columns == ["name", "q/id", "disputed_reason"] and got(named) == [("one", 88, None), ("two", None, None)]
    assert got(cw.ids_to_rows(named, ids, id_columns={"p": "name"})) == got(index.df)
    with pytest.raises(ValueError):
        cw.rows_to_ids(index, ids, id_columns={"z": "name"})
    with pytest.raises(ValueError, match="not in its lookup"):
        cw.ids_to_rows(named, {"p": ids["p"].where("id = 'one'")}, id_columns={"p": "name"})
    with pytest.raises(ValueError, match="unique"):
        cw.ids_to_rows(named, {"p": ids["p"].withColumn("id", ids["p"]["id"].substr(0, 0))}, id_columns={"p": "name"})


def test_storage_routes_agree(spark, tmp_path):
    mode = cw.EntitywiseCrossmatchConfig()
    want = got(cw.resolve(cw.build_edges(spark, THREE, **SETTINGS), mode).df)
    cw.build_edges_to_directory(spark, THREE, f"file://{tmp_path}/e", **SETTINGS)
    back = cw.read_edges(spark, f"file://{tmp_path}/e")
    assert got(cw.resolve(back, mode).df) == want and cw.segment_names(spark, f"file://{tmp_path}/e") == ["segment-0"]
    assert cw.read_edges_metadata(spark, f"file://{tmp_path}/e")["surveys"][0] == {"name": "a", "n_rows": 30, "dedupe_radius_arcsec": 0.25}
    # What is written again takes the place of what was there, of an outcome that found nothing too.
    rows = got(back.rows)
    cw.build_edges_to_directory(spark, THREE, f"file://{tmp_path}/e", **SETTINGS)
    assert got(cw.read_edges(spark, f"file://{tmp_path}/e").rows) == rows and got(cw.resolve(cw.read_edges(spark, f"file://{tmp_path}/e"), mode).df) == want
    cw.build_edges_to_directory(spark, {n: line(0, 50) for n in "ab"}, f"file://{tmp_path}/e2", radius_arcsec=1.0, dedupe_radius_arcsec=60.0)
    cw.build_edges_to_directory(spark, {n: line(0, 50) for n in "ab"}, f"file://{tmp_path}/e2", radius_arcsec=1.0, dedupe_radius_arcsec=0.0)
    assert cw.read_edges(spark, f"file://{tmp_path}/e2").outcomes.count() == 0 and cw.read_edges(spark, f"file://{tmp_path}/e2").edges.count() == 2
    cw.resolve_to_file(spark, f"file://{tmp_path}/e", mode, f"file://{tmp_path}/index")
    saved = spark.read.parquet(f"file://{tmp_path}/index")
    assert got(saved) == want and cw.index_summary(saved)["n_entities"] == len(want)
    cw.write_band_layout(spark, f"file://{tmp_path}/layout", {n: cw.as_chunks(*c, 3) for n, c in THREE.items()}, band_height_deg=0.01)
    for bands in cw.prepare_band_build(spark, f"file://{tmp_path}/layout", f"file://{tmp_path}/b", **SETTINGS):
        cw.build_band(spark, f"file://{tmp_path}/b", bands)
    cw.sweep_boundaries(spark, f"file://{tmp_path}/b")
    banded = cw.read_edges(spark, f"file://{tmp_path}/b")
    assert got(cw.resolve(banded, mode).df) == want
    parts = [cw.read_segment(spark, f"file://{tmp_path}/b", n) for n in cw.segment_names(spark, f"file://{tmp_path}/b")]
    assert got(cw.resolve(cw.combine_segments(parts), mode).df) == want
    with pytest.raises(ValueError):
        cw.read_segment(spark, f"file://{tmp_path}/b", "nope")
    with pytest.raises(ValueError):
        cw.combine_segments([])
    with pytest.raises(ValueError, match="band"):
        cw.prepare_band_build(spark, f"file://{tmp_path}/layout", f"file://{tmp_path}/x", **{**SETTINGS, "radius_arcsec": 60.0})


def test_bands_with_chains(spark, tmp_path):
    """A chain over all bands is one group, decided once."""
    surveys = {"p": line(0.1, 1.5, 2.9, 4.3), "q": line(0.8, 2.2, 3.6)}
    cw.write_band_layout(spark, f"file://{tmp_path}/l", surveys, band_height_deg=0.9 / 3600)
    cw.build_edges_by_band(spark, f"file://{tmp_path}/l", f"file://{tmp_path}/e", radius_arcsec=0.75, dedupe_radius_arcsec=0.0)
    assert all(n.startswith("boundary-") for n in cw.segment_names(spark, f"file://{tmp_path}/e"))
    want = sorted(plain.pairs(places(surveys["p"]), places(surveys["q"]), 0.75))
    assert got(cw.read_edges(spark, f"file://{tmp_path}/e").pair("p", "q").select("row_a", "row_b")) == want and len(want) == 6
    cw.write_band_layout(spark, f"file://{tmp_path}/m", {"p": line(*(0.8 * k for k in range(45)))}, band_height_deg=3 / 3600)
    with pytest.raises(RuntimeError, match="over one band boundary"):
        cw.build_edges_by_band(spark, f"file://{tmp_path}/m", f"file://{tmp_path}/f", radius_arcsec=1.0, dedupe_radius_arcsec=1.0, max_carried_rows=15)


def test_read_catalogue_and_stream(spark, tmp_path):
    from catweave.sources.storage import read_bands, read_layout
    from catweave.streaming.ingest import finish_layout, layout_writer

    df = spark.createDataFrame([(float(i), float(i % 90)) for i in range(50)], "ra double, dec double")
    df.coalesce(1).write.parquet(f"{tmp_path}/c")
    assert got(cw.read_catalogue(spark, f"{tmp_path}/c"))[7] == (7, 7.0, 7.0)
    layout = f"file://{tmp_path}/layout"
    c = field(31, {"p": 30, "q": 24})

    def feed(name, part):
        rows = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(part)], "at long, ra double, dec double")
        rows.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in-{name}")
        stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in-{name}")
        q = layout_writer(stream, layout, name, band_height_deg=0.01, order="at").option("checkpointLocation", f"{tmp_path}/cp-{name}").trigger(availableNow=True).start()
        q.awaitTermination()

    with pytest.raises(ValueError, match="band height"):
        finish_layout(spark, layout, ["p", "q"])
    feed("p", places(c["p"])[:20])
    feed("q", places(c["q"]))
    feed("p", places(c["p"])[20:])
    finish_layout(spark, layout, ["p", "q", "none"])
    assert got(read_bands(spark, layout, "p").select("row", "ra", "dec")) == [(i, *x) for i, x in enumerate(places(c["p"]))]
    cw.build_edges_by_band(spark, layout, f"file://{tmp_path}/e", radius_arcsec=0.8, dedupe_radius_arcsec=0.0)
    assert got(cw.read_edges(spark, f"file://{tmp_path}/e").pair("p", "q").select("row_a", "row_b")) == sorted(plain.pairs(places(c["p"]), places(c["q"]), 0.8))
    with pytest.raises(Exception, match="finite"):
        feed("q", [(float("nan"), 0.0)])
    finish_layout(spark, layout, ["p", "q"])
    assert read_bands(spark, layout, "q").count() == 24 == read_layout(spark, layout)["surveys"][1]["n_rows"]


def test_kernel_and_outcomes(spark):
    c = field(9, {"p": 24, "q": 20}, spots=9)
    kernel, other = cw.CatalogKernel(spark, c["p"], name="p"), cw.CatalogKernel(spark, c["q"], name="q")
    assert len(kernel) == 24 and kernel and len(cw.CatalogKernel(spark, ([], []))) == 0
    own = places(c["p"])
    assert got(kernel.self_pairs(0.8).select("row_a", "row_b")) == sorted((i, j) for i, j in plain.pairs(own, own, 0.8) if i < j)
    cross = plain.pairs(own, places(c["q"]), 0.5)
    assert got(kernel.all_pairs(other, 0.5).select("row_a", "row_b")) == sorted(cross)
    chunks = [[tuple(r) for r in k.select("row_a", "row_b").collect()] for k in kernel.all_pairs_chunks(other, 0.5, chunk_rows=10)]
    assert len(chunks) == 3 and sum(chunks, []) == sorted(cross) and all(10 * k <= i < 10 * k + 10 for k, part in enumerate(chunks) for i, _ in part)
    for bad in ({"workers": 0}, {"chunk_rows": 0}):
        with pytest.raises(ValueError):
            kernel.all_pairs_chunks(other, 0.5, **bad)
    found = plain.dedupe(own, 0.4)
    assert got(kernel.dedupe(0.4)) == got_list((r, *v) for r, v in found.items())
    with pytest.raises(ValueError, match="finite"):
        cw.CatalogKernel(spark, ([float("nan")], [0.0]))
    edges = cw.build_edges(spark, {"p": kernel.df, "q": other.df}, radius_arcsec=0.5, dedupe_radius_arcsec=0.4, dedupe_radius_arcsec_overrides={"q": 0.0})
    a, b = edges.outcome("p"), edges.outcome("q")
    assert got(a.dropped_rows()) == sorted((r, k) for r, (s, k) in found.items() if s == "dropped") and got(a.disputed_rows()) == sorted((r,) for r, (s, _) in found.items() if s == "disputed")
    assert got(a.active_rows()) == [(r,) for r in range(24) if r not in found]
    assert a.counts["n_active"] == 24 - len(found) and b.counts == {"n_covered": 20, "n_dropped": 0, "n_disputed": 0, "n_active": 20}
    pair = edges.pair_edges("q", "p")
    assert (pair.survey_a, pair.radius_arcsec) == ("q", 0.5) and [tuple(r)[:2] for r in pair.ordered().collect()] == sorted((j, i) for i, j in cross if i not in found)
    assert edges.stored().stored().is_stored and got(edges.stored().edges) == got(edges.edges)
    with pytest.raises(ValueError, match="unknown survey"):
        edges.outcome("z")
