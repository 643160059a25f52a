"""The result of matching: an index of row positions, its metadata, and the way to caller ids and back."""

from __future__ import annotations

import functools
import json
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PREFIX = "catweave"


def row_column(name: str) -> str:
    return f"{name}/row_index"


def pair_name(a: str, b: str) -> str:
    return f"{a}+{b}"


def separation_column(a: str, b: str) -> str:
    return f"{pair_name(a, b)}/separation_arcsec"


def encode_metadata(value: Any) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), allow_nan=False)


def column(name: str) -> F.Column:
    return F.col(f"`{name}`")


@dataclass
class MatchIndex:
    """``df`` has the columns in their order; ``sort_keys`` give the order of rows.

    Counts in the summary need jobs and are made when first asked for.
    """

    df: DataFrame
    surveys: tuple[str, ...]
    sort_keys: list[F.Column]
    static: dict[str, Any] = field(default_factory=dict)
    count: Callable[[], dict[str, Any]] = dict

    def ordered(self) -> DataFrame:
        return self.df.orderBy(*self.sort_keys)

    @functools.cached_property
    def summary(self) -> dict[str, Any]:
        return self.count()

    @property
    def metadata(self) -> dict[str, str]:
        return {f"{PREFIX}.{k}": v if isinstance(v, str) else encode_metadata(v) for k, v in (self.static | {"summary": self.summary}).items()}

    def with_metadata(self) -> DataFrame:
        """The ordered frame with the metadata on its first column, where Parquet keeps it."""
        df = self.ordered()
        first = df.columns[0]
        return df.select(column(first).alias(first, metadata=self.metadata), *(column(c) for c in df.columns[1:]))


def index_summary(index: MatchIndex | DataFrame) -> dict[str, Any]:
    """The summary of a result, or of one saved with its metadata."""
    if isinstance(index, MatchIndex):
        return index.summary
    return json.loads(index.schema[0].metadata[f"{PREFIX}.summary"])


def first_present(names: tuple[str, ...] | list[str]) -> list[F.Column]:
    """Sort keys: the first survey that is present, then its row."""
    which = functools.reduce(lambda c, i: c.when(column(row_column(names[i])).isNotNull(), i), range(1, len(names)), F.when(column(row_column(names[0])).isNotNull(), 0))
    return [which, F.coalesce(*(column(row_column(n)) for n in names))]


def rows_to_ids(matches: MatchIndex | DataFrame, ids: Mapping[str, DataFrame], *, id_columns: Mapping[str, str] | None = None) -> DataFrame:
    """Row columns replaced in place by ids (``row, id`` frames); an absent row stays null."""
    df = matches.df if isinstance(matches, MatchIndex) else matches
    named = dict(id_columns or {})
    if extra := set(named) - set(ids):
        raise ValueError(f"id_columns names surveys without ids: {sorted(extra)}")
    for n, lookup in ids.items():
        old, new = row_column(n), named.get(n, f"{n}/id")
        if old not in df.columns:
            raise ValueError(f"there is no column {old}")
        order = df.columns
        df = df.join(lookup.select(F.col("row").alias("_row"), F.col("id").alias("_id")), column(old) == F.col("_row"), "left")
        df = df.select(*(F.col("_id").alias(new) if c == old else column(c) for c in order))
    return df


def ids_to_rows(matches: DataFrame, ids: Mapping[str, DataFrame], *, id_columns: Mapping[str, str] | None = None) -> DataFrame:
    """The inverse; ids must be unique and known, and raise ``ValueError`` with examples if not."""
    named = dict(id_columns or {})
    if extra := set(named) - set(ids):
        raise ValueError(f"id_columns names surveys without ids: {sorted(extra)}")
    df = matches
    for n, lookup in ids.items():
        old = named.get(n, f"{n}/id")
        if old not in df.columns:
            if n in named:
                raise ValueError(f"there is no column {old}")
            continue
        look = lookup.select(F.col("id").cast(lookup.schema["id"].dataType).alias("_id"), F.col("row").alias("_row"))
        total, known, distinct = look.agg(F.count("*"), F.count("_id"), F.countDistinct("_id")).first()
        if known < total:
            raise ValueError(f"the ids of {n} contain nulls")
        if distinct < total:
            raise ValueError(f"the ids of {n} are not unique")
        kind = lookup.schema["id"].dataType
        strange = df.where(column(old).isNotNull()).select(column(old).cast(kind).alias("_id")).join(look, "_id", "left_anti").limit(5).collect()
        if strange:
            raise ValueError(f"ids of {n} are not in its lookup: {[r[0] for r in strange]}")
        order = df.columns
        df = df.join(look, column(old).cast(kind) == F.col("_id"), "left")
        df = df.select(*(F.col("_row").alias(row_column(n)) if c == old else column(c) for c in order))
    return df
