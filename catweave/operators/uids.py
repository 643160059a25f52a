"""Exact joins of any number of sources on unique identifiers."""

from __future__ import annotations

import functools
from collections.abc import Mapping, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.index import MatchIndex, column, row_column
from ..sources.shared import numbered
from .edges import check_survey_names

JOINS = ("inner", "left", "outer")
WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
MOST = (1 << 64) - 1


def identifiers(spark: SparkSession, values: Any, name: str) -> DataFrame:
    """``row, uid`` of a frame with these columns, or of an array-like (row: position)."""
    if isinstance(values, DataFrame):
        if {"row", "uid"} - set(values.columns):
            raise ValueError(f"{name} must have the columns row and uid")
        return values.select(F.col("row").cast("long").alias("row"), "uid")
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    kind = values.type if isinstance(values, pa.Array) else None
    if kind is not None and not (pa.types.is_integer(kind) or pa.types.is_string(kind) or pa.types.is_large_string(kind)):
        raise ValueError(f"{name}: identifiers must be integers or strings, not {kind}")
    items = values.to_pylist() if kind is not None else [v.item() if hasattr(v, "item") else v for v in values]
    real = [v for v in items if v is not None]
    if kind is not None and not real:
        real_kind = "string" if not pa.types.is_integer(kind) else "long"
    elif not real:
        real_kind = "void"
    elif all(isinstance(v, str) for v in real):
        real_kind = "string"
    elif all(isinstance(v, int) and not isinstance(v, bool) for v in real):
        if min(real) >= -(1 << 63) and max(real) < 1 << 63:
            real_kind = "long"
        elif min(real) >= 0 and max(real) <= MOST:
            real_kind = "decimal(20,0)"
        else:
            raise ValueError(f"{name}: the identifiers don't fit one 64-bit integer type")
    else:
        raise ValueError(f"{name}: identifiers must be all integers or all strings")
    if real_kind == "decimal(20,0)":
        rows = spark.createDataFrame([(i, None if v is None else str(v)) for i, v in enumerate(items)], "row long, uid string")
        return rows.withColumn("uid", F.col("uid").cast("decimal(20,0)"))
    return spark.createDataFrame([(i, v) for i, v in enumerate(items)], f"row long, uid {'long' if real_kind == 'void' else real_kind}").withMetadata("uid", {"untyped": real_kind == "void"})


def _family(kind: T.DataType, name: str) -> str:
    if isinstance(kind, WHOLE) or isinstance(kind, T.DecimalType) and (kind.precision, kind.scale) == (20, 0):
        return "integer"
    if isinstance(kind, T.StringType):
        return "string"
    raise ValueError(f"{name}: identifiers must be integers or strings, not {kind.simpleString()}")


def match_uids(spark: SparkSession, uids: Mapping[str, Any], *, join: str = "inner", anchor: str | None = None, check: bool = True) -> MatchIndex:
    """Rows of all sources that share an identifier.

    ``inner`` keeps identifiers that every source has, ``left`` all of the anchor (by default the first
    source), ``outer`` all. Rows come in the order of the anchor, then, for ``outer``, of the other sources'
    unseen identifiers; ``entity_id`` numbers them. One shuffle by identifier serves any number of sources.
    ``check=False`` leaves out the job that proves identifiers unique and not null.
    """
    names = list(uids)
    if len(names) < 2:
        raise ValueError("at least two sources are needed")
    check_survey_names(names)
    if join not in JOINS:
        raise ValueError(f"unknown join {join!r}")
    anchor = names[0] if anchor is None else anchor
    if anchor not in names:
        raise ValueError(f"unknown anchor {anchor!r}")
    frames = {n: identifiers(spark, v, n) for n, v in uids.items()}
    untyped = {n for n, f in frames.items() if f.schema["uid"].metadata.get("untyped")}
    families = {n: _family(f.schema["uid"].dataType, n) for n, f in frames.items() if n not in untyped}
    if len(set(families.values())) > 1:
        raise ValueError(f"identifiers must be all integers or all strings, there is no coercion: {families}")
    if next(iter(families.values()), "integer") == "string":
        kind = "string"
    else:
        kind = "decimal(20,0)" if any(isinstance(f.schema["uid"].dataType, T.DecimalType) for f in frames.values()) else "long"
    every = functools.reduce(DataFrame.unionAll, [f.select(F.lit(i).alias("source"), "row", F.col("uid").cast(kind).alias("uid")) for i, f in enumerate(frames.values())])
    if check:
        per_key = every.groupBy("source", "uid").agg(F.count("*").alias("n"))
        for r in per_key.groupBy("source").agg(F.max("n").alias("n"), F.count_if(F.col("uid").isNull()).alias("nulls")).collect():
            if r["nulls"]:
                raise ValueError(f"{names[r['source']]}: identifiers must not be null")
            if r["n"] > 1:
                raise ValueError(f"{names[r['source']]}: identifiers must be unique")
    grouped = every.groupBy("uid").agg(*(F.max(F.when(F.col("source") == i, F.col("row"))).alias(row_column(n)) for i, n in enumerate(names)))
    if join == "inner":
        for n in names:
            grouped = grouped.where(column(row_column(n)).isNotNull())
    elif join == "left":
        grouped = grouped.where(column(row_column(anchor)).isNotNull())
    order = source_order(names, anchor)
    first = functools.reduce(lambda c, k: c.when(column(row_column(order[k])).isNotNull(), k), range(1, len(order)), F.when(column(row_column(anchor)).isNotNull(), 0))
    keyed = grouped.select(first.alias("_k"), F.coalesce(*(column(row_column(n)) for n in order)).alias("_r"), *(column(row_column(n)) for n in names))
    df = numbered(keyed, "entity_id", "_k", "_r").select("entity_id", *(column(row_column(n)) for n in names))
    static = {
        "method": "uid", "join": join, "anchor": anchor, "uid_type": {n: frames[n].schema["uid"].dataType.simpleString() for n in names},
        "duplicates": "rejected", "nulls": "rejected", "ordering": "anchor rows, then unseen rows of the other sources in their order",
    }
    return MatchIndex(df, tuple(names), [F.col("entity_id")], static, lambda: {"mode": "uid", "join": join, "n_rows": df.count()})


def source_order(names: Sequence[str], anchor: str) -> list[str]:
    return [anchor, *(n for n in names if n != anchor)]
