"""Duplicates within a catalogue: cliques keep their lowest row, other groups are disputed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import signatures
from .spatial import self_pairs

SCHEMA = "row long, status string, kept_row long"


def dedupe_from_pairs(pairs: DataFrame, first: str = "row_a", second: str = "row_b") -> DataFrame:
    """``row, status, kept_row`` of the rows that pairs within a catalogue drop or dispute."""
    s = signatures(pairs, first, second)
    kept = F.element_at("signature", 1)
    judged = s.select(F.col("node").alias("row"), F.when(F.col("is_clique"), "dropped").otherwise("disputed").alias("status"), F.when(F.col("is_clique"), kept).alias("kept_row"))
    return judged.where("kept_row IS NULL OR kept_row != row")


def dedupe_survey(catalogue: DataFrame, radius_arcsec: float) -> DataFrame:
    """The same from coordinates; a radius of 0 finds nothing."""
    if radius_arcsec == 0:
        return catalogue.sparkSession.createDataFrame([], SCHEMA)
    return dedupe_from_pairs(self_pairs(catalogue, radius_arcsec))
