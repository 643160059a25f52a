"""Reductions of candidate pairs to one-to-one or anchored pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

POLICIES = ("anchored_nearest", "anchored_unique", "mutual_nearest", "mutual_unique")


def check_policy(policy: str) -> None:
    if policy not in POLICIES:
        raise ValueError(f"{policy!r} is none of the pair policies {', '.join(POLICIES)}")


def one_to_one_pairs(pairs: DataFrame, policy: str, first: str = "row_a", second: str = "row_b", separation: str = "separation_arcsec") -> DataFrame:
    """The pairs a policy keeps.

    Anchored policies look from the first side only; nearest ones take the pair of least separation among
    all candidates, ties to the lower other row; unique ones keep a row that has one candidate.
    """
    check_policy(policy)
    nearest = policy.endswith("nearest")

    def keep(own: str, other: str) -> F.Column:
        w = Window.partitionBy(own)
        return F.row_number().over(w.orderBy(separation, other)) == 1 if nearest else F.count("*").over(w) == 1

    out = pairs.withColumn("_keep", keep(first, second))
    if policy.startswith("mutual"):
        # Both sides are judged among all candidates.
        out = out.withColumn("_back", keep(second, first)).where("_back").drop("_back")
    return out.where("_keep").drop("_keep")
