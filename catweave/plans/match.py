"""Entry points: edges, then a decision."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import SparkSession

from ..operators.edges import CandidateEdges, build_edges
from ..operators.modes import CrossmatchModeConfig, iter_required, mode_to_mapping, required_pairs
from .index import MatchIndex


def resolve(edges: CandidateEdges, mode: CrossmatchModeConfig) -> MatchIndex:
    """The index of candidate edges under a mode, with provenance."""
    missing = required_pairs(mode, edges.survey_names) - set(edges.settings.pair_radius)
    if missing:
        raise ValueError(f"the edges were built without survey pairs the mode needs: {sorted(sorted(p) for p in missing)}")
    index = mode.build(edges)
    index.static["resolved_config"] = {
        "surveys": [{"name": n, "dedupe_radius_arcsec": edges.settings.dedupe_radius[n]} for n in edges.survey_names],
        "pair_radius_arcsec": edges.radius_metadata(list(iter_required(mode, edges.survey_names))),
        "mode": mode_to_mapping(mode),
    }
    made = index.count

    def count() -> dict:
        index.static["dedupe"] = {n: {"radius_arcsec": edges.settings.dedupe_radius[n], **c} for n, c in edges.dedupe_counts.items()}
        return made()

    index.count = count
    return index


def crossmatch(spark: SparkSession, coordinates: Mapping[str, Any], *, radius_arcsec: float, dedupe_radius_arcsec: float, mode: CrossmatchModeConfig, **settings: Any) -> MatchIndex:
    """Build only the pairs the mode reads, and resolve them."""
    pairs = required_pairs(mode, list(coordinates))
    return resolve(build_edges(spark, coordinates, radius_arcsec=radius_arcsec, dedupe_radius_arcsec=dedupe_radius_arcsec, pairs=pairs, **settings), mode)
