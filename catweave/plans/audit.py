"""What candidate edges look like, before resolving them."""

from __future__ import annotations

from itertools import combinations
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.edges import CandidateEdges
from ..operators.graph import position_of
from ..operators.modes import labelled, node_edges, nodes_of

PERCENTS = (5, 25, 50, 75, 95)
LARGEST = 5


def duplicate_groups(edges: CandidateEdges) -> DataFrame:
    """``survey, n_duplicate_groups, largest_duplicate_group``."""
    per = edges.outcomes.where("status = 'dropped'").groupBy("survey", "kept_row").agg((F.count("*") + 1).alias("n"))
    return per.groupBy("survey").agg(F.count("*").alias("n_duplicate_groups"), F.max("n").alias("largest_duplicate_group"))


def pair_facts(edges: CandidateEdges) -> DataFrame:
    """By pair: edges, matched rows and rows with several candidates on each side, separation percentiles."""
    edges = edges.stored()
    key = ["survey_a", "survey_b"]
    e = edges.edges
    main = e.groupBy(*key).agg(F.count("*").alias("n_edges"), F.percentile("separation_arcsec", F.array(*(F.lit(p / 100) for p in PERCENTS))).alias("percentiles"))
    for side in "ab":
        per = e.groupBy(*key, f"row_{side}").agg(F.count("*").alias("n"))
        main = main.join(per.groupBy(*key).agg(F.count("*").alias(f"matched_{side}"), F.count_if(F.col("n") > 1).alias(f"multi_{side}")), key)
    return main


def component_facts(edges: CandidateEdges) -> DataFrame:
    """One row per component of active rows: ``component, n, bits`` (survey mask), ``is_clique``."""
    edges = edges.stored()
    links = node_edges(edges)
    labels, _ = labelled(links)
    alone = nodes_of(edges.active(), edges.survey_names).join(labels, "node", "left_anti")
    every = labels.unionByName(alone.select("node", F.col("node").alias("component"), F.lit(True).alias("is_clique")))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), position_of(F.col("node")))
    return every.groupBy("component").agg(F.count("*").alias("n"), F.bit_or(bit).alias("bits"), F.bool_and("is_clique").alias("is_clique"))


def audit_edges(edges: CandidateEdges) -> dict[str, Any]:
    """Surveys, pairs and components in plain JSON types.  All results collected are a few rows a survey,
    pair or combination of surveys."""
    edges = edges.stored()
    names, radii = edges.survey_names, edges.settings
    counts = edges.dedupe_counts
    groups = {r["survey"]: r for r in duplicate_groups(edges).collect()}
    active = {n: c["n_rows"] - c["n_dropped"] - c["n_disputed"] for n, c in counts.items()}
    surveys = [
        {
            "name": n, "n_rows": counts[n]["n_rows"], "dedupe_radius_arcsec": radii.dedupe_radius[n], "n_active": active[n], "n_dropped": counts[n]["n_dropped"],
            "n_disputed": counts[n]["n_disputed"], "n_duplicate_groups": groups[n]["n_duplicate_groups"] if n in groups else 0,
            "largest_duplicate_group": groups[n]["largest_duplicate_group"] if n in groups else 0,
        }
        for n in names
    ]
    facts = {(r["survey_a"], r["survey_b"]): r for r in pair_facts(edges).collect()}
    pairs = []
    for p in combinations(names, 2):
        if frozenset(p) not in radii.pair_radius:
            continue
        r = facts.get(p)
        pairs.append(
            {
                "surveys": list(p), "radius_arcsec": radii.pair_radius[frozenset(p)], "n_edges": r["n_edges"] if r else 0,
                "separation_arcsec": {f"p{q}": round(v, 4) for q, v in zip(PERCENTS, r["percentiles"])} if r else None,
                "matched_row_fraction": {n: round(r[f"matched_{s}"] / active[n], 6) if r and active[n] else 0.0 for n, s in zip(p, "ab")},
                "multi_candidate_rows": {n: r[f"multi_{s}"] if r else 0 for n, s in zip(p, "ab")},
            }
        )
    census = component_facts(edges).groupBy("bits", F.least("n", F.lit(LARGEST + 1)).alias("size"), "is_clique").agg(F.count("*").alias("k"), F.sum("n").alias("rows"), F.max("n").alias("most")).collect()
    components: dict[str, Any] = {"n_rows": sum(r["rows"] for r in census), "n_components": sum(r["k"] for r in census)}
    if census:
        sizes = {str(i): 0 for i in range(1, LARGEST + 1)} | {f">={LARGEST + 1}": 0}
        combos: dict[str, dict[str, int]] = {}
        for r in census:
            sizes[str(r["size"]) if r["size"] <= LARGEST else f">={LARGEST + 1}"] += r["k"]
            if r["size"] > 1:
                name = "+".join(n for i, n in enumerate(names) if r["bits"] >> i & 1)
                c = combos.setdefault(name, {"n_components": 0, "n_clean": 0})
                c["n_components"] += r["k"]
                c["n_clean"] += r["k"] * r["is_clique"]
        components |= {
            "max_size": max(r["most"] for r in census), "size_histogram": sizes, "n_clean_multi_survey": sum(r["k"] for r in census if r["size"] > 1 and r["is_clique"]),
            "n_ambiguous": sum(r["k"] for r in census if not r["is_clique"]), "rows_in_ambiguous": sum(r["rows"] for r in census if not r["is_clique"]),
            "by_survey_combination": dict(sorted(combos.items())),
        }
    return {"all_pairs_built": len(radii.pair_radius) == len(names) * (len(names) - 1) // 2, "surveys": surveys, "pairs": pairs, "components": components}
