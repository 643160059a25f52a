"""Matching of astronomical catalogues on Spark."""

from .functions.sphere import arcsec_to_chord, chord_to_arcsec
from .operators.edges import CandidateEdges, DedupeOutcome, EdgeSettings, PairEdges, build_edges, combine_segments, edge_settings
from .operators.hub import SpatialLink, UIDLink, match_hub_and_spoke
from .operators.kernel import CatalogKernel
from .operators.modes import CrossmatchModeConfig, DegenerateCrossmatchConfig, EntitySelectionConfig, EntitywiseCrossmatchConfig, mode_to_mapping
from .operators.policies import one_to_one_pairs
from .operators.spatial import all_pairs, self_pairs
from .operators.uids import match_uids
from .plans.audit import audit_edges
from .plans.index import MatchIndex, ids_to_rows, index_summary, rows_to_ids
from .plans.match import crossmatch, resolve
from .sources.catalog import as_chunks, catalogue, read_catalogue
from .sources.storage import (
    build_band, build_edges_by_band, build_edges_to_directory, prepare_band_build, read_edges, read_edges_metadata, read_segment,
    resolve_to_file, segment_names, sweep_boundaries, write_band_layout, write_edges, write_metadata, write_segment,
)

__version__ = "0.1.0"
__all__ = [n for n in dir() if not n.startswith("_")]
