"""Modes: how candidate edges become an index."""

from __future__ import annotations

import dataclasses
from abc import ABC, abstractmethod
from collections.abc import Collection, Iterator, Sequence
from dataclasses import dataclass
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.index import MatchIndex, column, first_present, row_column, separation_column
from ..sources.shared import written
from .components import connected_components
from .edges import CandidateEdges
from .graph import node, position_of, row_of, signatures
from .policies import check_policy, one_to_one_pairs
from .resolvers import sequential_component, split_component

AMBIGUOUS, DISPUTED = "ambiguous_component", "dedupe_disputed"
RESOLVERS, DISPOSITIONS = ("refuse", "split", "sequential"), ("singleton", "drop")


class CrossmatchModeConfig(ABC):
    """Subclass this for another way to decide."""

    @abstractmethod
    def build(self, edges: CandidateEdges) -> MatchIndex: ...

    def required_surveys(self) -> Collection[str] | None:
        """The surveys the mode reads; None for all."""
        return None

    def requires_all_surveys(self) -> bool:
        return self.required_surveys() is None


def mode_to_mapping(mode: CrossmatchModeConfig) -> dict:
    """The mode as its class and arguments."""
    args = {f.name: getattr(mode, f.name) for f in dataclasses.fields(mode)} if dataclasses.is_dataclass(mode) else {}
    plain = lambda v: {"class_path": _path(v), "init_args": dataclasses.asdict(v)} if dataclasses.is_dataclass(v) else list(v) if isinstance(v, tuple) else v
    return {"class_path": _path(mode), "init_args": {k: plain(v) for k, v in args.items()}}


def _path(value: object) -> str:
    return f"{type(value).__module__}.{type(value).__qualname__}"


@dataclass(frozen=True)
class DegenerateCrossmatchConfig(CrossmatchModeConfig):
    """An inner join of the surveys under one pair policy; every pair of a group must agree."""

    surveys: tuple[str, ...]
    policy: str = "mutual_nearest"

    def __post_init__(self) -> None:
        object.__setattr__(self, "surveys", tuple(self.surveys))
        check_policy(self.policy)
        if len(set(self.surveys)) != len(self.surveys) or len(self.surveys) < 2:
            raise ValueError("a degenerate mode needs two or more different surveys")
        if self.policy.startswith("anchored") and len(self.surveys) != 2:
            raise ValueError(f"{self.policy} looks from one survey at one other; {len(self.surveys)} are given")

    def required_surveys(self) -> tuple[str, ...]:
        return self.surveys

    def build(self, edges: CandidateEdges) -> MatchIndex:
        pairs = list(combinations(self.surveys, 2))
        out: DataFrame | None = None
        for a, b in pairs:
            kept = one_to_one_pairs(edges.pair(a, b), self.policy).select(
                F.col("row_a").alias(row_column(a)), F.col("row_b").alias(row_column(b)), F.col("separation_arcsec").cast("float").alias(separation_column(a, b))
            )
            out = kept if out is None else out.join(kept, [c for c in kept.columns if c in out.columns])
        df = out.select(*(column(row_column(s)) for s in self.surveys), *(column(separation_column(a, b)) for a, b in pairs))
        static = {
            "match_index.mode": "degenerate", "match_index.surveys": list(self.surveys), "match_index.match_policy": self.policy,
            "match_index.pair_radius_arcsec": edges.radius_metadata(pairs),
        }
        return MatchIndex(df, self.surveys, [column(row_column(self.surveys[0])), *(column(row_column(s)) for s in self.surveys[1:])], static, lambda: {"mode": "degenerate", "policy": self.policy, "surveys": list(self.surveys), "n_groups": df.count()})


@dataclass(frozen=True)
class EntitySelectionConfig:
    """Which entities to keep once all are resolved."""

    min_surveys: int = 1
    must_include_surveys: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if self.min_surveys < 1:
            raise ValueError("min_surveys must be at least 1")
        object.__setattr__(self, "must_include_surveys", tuple(sorted(self.must_include_surveys)))

    def check(self, names: Sequence[str]) -> None:
        if self.min_surveys > len(names):
            raise ValueError(f"min_surveys is {self.min_surveys} but there are {len(names)} surveys")
        if missing := set(self.must_include_surveys) - set(names):
            raise ValueError(f"must_include_surveys names unknown surveys: {sorted(missing)}")


def node_edges(edges: CandidateEdges) -> DataFrame:
    """All edges between nodes: ``u`` (of the earlier survey), ``v``, ``separation_arcsec``."""
    place = F.create_map(*(x for i, n in enumerate(edges.survey_names) for x in (F.lit(n), F.lit(i).cast("long"))))
    at = lambda c: F.shiftleft(place[F.col(f"survey_{c}")], 48) + F.col(f"row_{c}")
    return edges.edges.select(at("a").alias("u"), at("b").alias("v"), "separation_arcsec")


def nodes_of(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """``node`` for frames with ``survey, row``."""
    place = F.create_map(*(x for i, n in enumerate(names) for x in (F.lit(n), F.lit(i).cast("long"))))
    return rows.select((F.shiftleft(place[F.col("survey")], 48) + F.col("row")).alias("node"))


def labelled(links: DataFrame, signed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``node, component, is_clique`` of every node of an edge, and the edges of what is no clique.

    Only components that are no cliques are labelled by iteration; ``signed`` are stored signatures of the links.
    """
    if signed is None:
        signed = written(signatures(links), "signatures")
    clean = signed.where("is_clique").select("node", F.element_at("signature", 1).alias("component"), F.lit(True).alias("is_clique"))
    rest = signed.where("NOT is_clique").select(F.col("node").alias("u"))
    residue = written(links.join(rest, "u", "left_semi"), "residue")
    odd = connected_components(residue, "u", "v", written).select("node", "component", F.lit(False).alias("is_clique"))
    return clean.unionByName(odd), residue


@dataclass(frozen=True)
class EntitywiseCrossmatchConfig(CrossmatchModeConfig):
    """Every row in exactly one entity; components that are no cliques go to a resolver."""

    resolver: str = "refuse"
    disputed: str = "singleton"
    priority: tuple[str, ...] | None = None
    size_cap: int = 30
    selection: EntitySelectionConfig | None = None

    def __post_init__(self) -> None:
        if self.resolver not in RESOLVERS:
            raise ValueError(f"unknown resolver {self.resolver!r}")
        if self.disputed not in DISPOSITIONS:
            raise ValueError(f"unknown disposition {self.disputed!r} of disputed rows")
        if self.priority is not None:
            if self.resolver != "sequential":
                raise ValueError("priority is only for the sequential resolver")
            object.__setattr__(self, "priority", tuple(self.priority))

    def _ranks(self, names: Sequence[str]) -> list[int]:
        if self.priority is None:
            return list(range(len(names)))
        if sorted(self.priority) != sorted(names):
            raise ValueError("priority must name every survey once")
        return [list(names).index(n) for n in self.priority]

    def _resolved(self, links: DataFrame, signed: DataFrame, names: Sequence[str]) -> tuple[DataFrame, DataFrame]:
        """``entity, node`` of groups, and ``node`` of components over the cap."""
        labels, residue = labelled(links, signed)
        sized = labels.where("NOT is_clique").groupBy("component").agg(F.count("*").alias("size"))
        odd = written(labels.where("NOT is_clique").join(sized, "component"), "ambiguous")
        small = residue.join(odd.where(F.col("size") <= self.size_cap).select(F.col("node").alias("u"), "component"), "u")
        ranks, resolver = self._ranks(names), self.resolver

        def solve(component: pa.Table) -> pa.Table:
            low = (1 << 48) - 1
            u, v, sep = (component.column(c).to_pylist() for c in ("u", "v", "separation_arcsec"))
            link = {frozenset(((a >> 48, a & low), (b >> 48, b & low))): s for a, b, s in zip(u, v, sep)}
            members = sorted({n for pair in link for n in pair})
            groups = split_component(members, link) if resolver == "split" else sequential_component(members, link, ranks)
            ids = [[s << 48 | r for s, r in g] for g in groups]
            return pa.table({"entity": pa.array([min(g) for g in ids for _ in g], pa.int64()), "node": pa.array([n for g in ids for n in g], pa.int64())})

        return small.groupBy("component").applyInArrow(solve, "entity long, node long"), odd.where(F.col("size") > self.size_cap).select("node")

    def build(self, edges: CandidateEdges) -> MatchIndex:
        names = edges.survey_names
        if self.selection is not None:
            self.selection.check(names)
        self._ranks(names)
        edges = edges.stored()
        links = node_edges(edges)
        signed = written(signatures(links), "signatures")
        none = F.lit(None).cast("string")
        clean = signed.where("is_clique").select(F.element_at("signature", 1).alias("entity"), "node", none.alias("reason"))
        groups: DataFrame | None = None
        if self.resolver == "refuse":
            refused = signed.where("NOT is_clique").select("node")
        else:
            groups, refused = self._resolved(links, signed, names)
        multi = clean if groups is None else clean.unionByName(groups.withColumn("reason", none))
        alone = nodes_of(edges.active(), names).join(signed.select("node"), "node", "left_anti")
        disputed = nodes_of(edges.outcomes.where("status = 'disputed'"), names)
        single = alone.withColumn("reason", none).unionByName(refused.withColumn("reason", F.lit(AMBIGUOUS))).unionByName(disputed.withColumn("reason", F.lit(DISPUTED)))

        def spread(pick) -> list:
            return [pick(F.when(position_of(F.col("node")) == i, row_of(F.col("node")))).alias(row_column(n)) for i, n in enumerate(names)]

        joined = multi.groupBy("entity").agg(*spread(F.max)).select(*(column(row_column(n)) for n in names), none.alias("disputed_reason"))
        every = joined.unionByName(single.select(*spread(lambda c: c), F.col("reason").alias("disputed_reason")))
        if self.disputed == "drop":
            every = every.where("disputed_reason IS NULL")
        chosen = every
        if self.selection is not None:
            present = sum(column(row_column(n)).isNotNull().cast("int") for n in names)
            chosen = chosen.where(present >= self.selection.min_surveys)
            for n in self.selection.must_include_surveys:
                chosen = chosen.where(column(row_column(n)).isNotNull())

        def counts() -> dict:
            labels, _ = labelled(links, signed)
            by = labels.groupBy("component", "is_clique").agg(F.count("*").alias("n"))
            cliques, odd, odd_rows = by.agg(F.count_if("is_clique"), F.count_if(~F.col("is_clique")), F.coalesce(F.sum(F.when(~F.col("is_clique"), F.col("n"))), F.lit(0))).first()
            out = {
                "mode": "entitywise", "resolver": self.resolver, "disputed": self.disputed, "n_entities": chosen.count(), "n_clean_components": cliques + alone.count(),
                "n_clean_multi_survey": cliques, "n_ambiguous_components": odd, "n_resolved_groups": groups.select("entity").distinct().count() if groups is not None else 0,
                "rows_in_ambiguous_components": odd_rows, "n_dedupe_disputed_rows": disputed.count(),
            }
            if self.selection is not None:
                clean_selected = chosen.where("disputed_reason IS NULL").count()
                if groups is not None:
                    # Resolved groups are no clean components.
                    firsts = groups.select("entity").distinct()
                    key = F.coalesce(*(node(i, column(row_column(n))) for i, n in enumerate(names)))
                    clean_selected -= chosen.where("disputed_reason IS NULL").select(key.alias("entity")).join(firsts, "entity", "left_semi").count()
                out |= {
                    "selection": {"min_surveys": self.selection.min_surveys, "must_include_surveys": list(self.selection.must_include_surveys)},
                    "n_entities_before_selection": every.count(), "n_selected_clean_components": clean_selected,
                }
            return out

        static = {
            "entity_index.surveys": list(names), "entity_index.resolver": self.resolver, "entity_index.disputed": self.disputed, "entity_index.size_cap": str(self.size_cap),
            "entity_index.pair_radius_arcsec": edges.radius_metadata(list(combinations(names, 2))),
        }
        if self.priority is not None:
            static["entity_index.priority"] = list(self.priority)
        if self.selection is not None:
            static["entity_index.selection.min_surveys"] = str(self.selection.min_surveys)
            static["entity_index.selection.must_include_surveys"] = list(self.selection.must_include_surveys)
        return MatchIndex(chosen, names, first_present(names), static, counts)


def required_pairs(mode: CrossmatchModeConfig, names: Sequence[str]) -> set[frozenset]:
    """The pairs a mode reads."""
    wanted = mode.required_surveys()
    wanted = list(names) if wanted is None else list(wanted)
    if unknown := set(wanted) - set(names):
        raise ValueError(f"the mode needs unknown surveys: {sorted(unknown)}")
    return {frozenset(p) for p in combinations(wanted, 2)}


def iter_required(mode: CrossmatchModeConfig, names: Sequence[str]) -> Iterator[tuple[str, str]]:
    pairs = required_pairs(mode, names)
    return (p for p in combinations(names, 2) if frozenset(p) in pairs)
