"""Connected components of an edge list too large for one machine.

Alternates two rewritings of the edges ("large star" and "small star", Kiveris et al., Connected
Components in MapReduce and Beyond, 2014) until every node points straight at the smallest node of its
component.  Every step is a minimum per node and a join back, so a node with very many neighbours is
aggregated before it is shuffled and its join can be split.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def connected_components(edges: DataFrame, first: str, second: str, materialize: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """``(node, component)`` for every node of an edge; a component is named by its smallest node.

    Edges are undirected, loops and repeats are harmless, nulls are dropped.  ``materialize`` stores a
    frame and cuts its lineage; it is called once a round.
    """
    a, b = F.col(first), F.col(second)
    now = materialize(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(a.isNotNull() & b.isNotNull() & (a != b)).distinct(), "edges")
    mark = _mark(now)
    while True:
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
        now = materialize(small.where("u != v").distinct(), "edges")
        before, mark = mark, _mark(now)
        if mark == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _mark(edges: DataFrame) -> tuple:
    """Count and checksum: equal when a round changed nothing."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
