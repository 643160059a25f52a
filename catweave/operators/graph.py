"""Graph facts about candidate edges: cliques without iteration, components where needed.

A node is ``survey position * 2**48 + row``.  A node's signature is the sorted set of its neighbours and
itself.  A component is a clique exactly if the nodes that share a signature are as many as it has
elements: they all lie in it, so they are it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHIFT = 48
MOST_SURVEYS = 63


def node(position: int, row: Column) -> Column:
    return row + F.lit(position << SHIFT)


def position_of(n: Column) -> Column:
    return F.shiftright(n, SHIFT).cast("int")


def row_of(n: Column) -> Column:
    return n.bitwiseAND(F.lit((1 << SHIFT) - 1))


def signatures(edges: DataFrame, first: str = "u", second: str = "v") -> DataFrame:
    """``node, signature, is_clique`` for each node of an edge."""
    both = edges.select(F.explode(F.array(F.struct(F.col(first).alias("node"), F.col(second).alias("other")), F.struct(F.col(second).alias("node"), F.col(first).alias("other")))).alias("e")).select("e.*")
    own = both.groupBy("node").agg(F.collect_set("other").alias("others"))
    signed = own.select("node", F.sort_array(F.array_union("others", F.array("node"))).alias("signature"))
    alike = F.count("*").over(Window.partitionBy("signature"))
    return signed.withColumn("is_clique", alike == F.size("signature"))
