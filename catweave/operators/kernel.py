"""One survey ready for spatial joins."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.catalog import catalogue, check_coordinates, with_vectors
from ..sources.shared import numbered
from .dedupe import dedupe_survey
from .spatial import all_pairs, self_pairs


class CatalogKernel:
    """A checked catalogue (a frame ``row, ra, dec`` or a pair of arrays) with its joins.

    ``check=False`` leaves out the job that validates coordinates.
    """

    def __init__(self, spark: SparkSession, source: Any, *, name: str = "catalogue", check: bool = True) -> None:
        self.name = name
        self.df = catalogue(spark, source, name)
        if check:
            self._n = check_coordinates({name: self.df})[name]

    @functools.cached_property
    def _n(self) -> int:
        return self.df.count()

    def __len__(self) -> int:
        return self._n

    def __bool__(self) -> bool:
        return True

    def vectors(self) -> DataFrame:
        """``row, x, y, z`` on the unit sphere."""
        return with_vectors(self.df)

    def self_pairs(self, radius_arcsec: float) -> DataFrame:
        """``row_a < row_b`` within the radius, rows at the same place included."""
        return self_pairs(self.df, radius_arcsec)

    def all_pairs(self, other: CatalogKernel, radius_arcsec: float, k: int | None = None) -> DataFrame:
        """Every pair with a row of ``other`` within the radius, or the ``k`` nearest of each row."""
        return all_pairs(self.df, other.df, radius_arcsec, k)

    def all_pairs_chunks(self, other: CatalogKernel, radius_arcsec: float, *, workers: int = -1, chunk_rows: int = 250_000) -> Iterator[DataFrame]:
        """``all_pairs`` as ordered frames, each over the next ``chunk_rows`` rows; no rows give one empty frame.

        Spark schedules the work of a frame; ``workers`` (-1 or at least 1) is only checked.
        """
        if workers != -1 and workers < 1:
            raise ValueError("workers must be -1 or at least 1")
        if chunk_rows < 1:
            raise ValueError("chunk_rows must be at least 1")
        placed = numbered(self.df, "_place", "row")

        def chunk(first: int) -> DataFrame:
            rows = placed.where(F.col("_place").between(first, first + chunk_rows - 1)).drop("_place")
            return all_pairs(rows, other.df, radius_arcsec).orderBy("row_a", "row_b")

        return map(chunk, range(0, max(1, len(self)), chunk_rows))

    def dedupe(self, radius_arcsec: float) -> DataFrame:
        """``row, status, kept_row`` of dropped and disputed rows."""
        return dedupe_survey(self.df, radius_arcsec)
