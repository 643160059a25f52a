"""Catalogues: frames of row positions and coordinates."""

from __future__ import annotations

import warnings
from collections.abc import Iterable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sphere import unit_vector


def read_catalogue(spark: SparkSession, path: str, ra: str = "ra", dec: str = "dec") -> DataFrame:
    """A Parquet file, or a folder of them in name order, as ``row, ra, dec``; row is the input position."""
    files = spark.read.parquet(path).select(ra, dec, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    from pyspark.sql import Window

    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    sizes = files.groupBy("_file").agg(F.count("*").alias("_n"))
    base = sizes.select("_file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    # A row a file, joined by shuffle unless Spark finds it small.
    return files.join(base, "_file").select((F.col("_base") + F.col("_at")).alias("row"), F.col(ra).alias("ra"), F.col(dec).alias("dec"))


def catalogue(spark: SparkSession, source: Any, name: str = "catalogue") -> DataFrame:
    """``row, ra, dec`` of a frame that has these columns, or of a pair of array-likes (row: position)."""
    if isinstance(source, DataFrame):
        missing = {"row", "ra", "dec"} - set(source.columns)
        if missing:
            raise ValueError(f"{name} lacks the columns {sorted(missing)}")
        types = dict(source.dtypes)
        for c in ("ra", "dec"):
            _warn(types[c] == "float", name, c)
        return source.select(F.col("row").cast("long").alias("row"), F.col("ra").cast("double").alias("ra"), F.col("dec").cast("double").alias("dec"))
    ra, dec = (np.asarray(x) for x in source)
    if ra.ndim != 1 or ra.shape != dec.shape:
        raise ValueError(f"{name}: ra and dec must be 1-D arrays of one length")
    for c, x in (("ra", ra), ("dec", dec)):
        _warn(x.dtype.kind == "f" and x.dtype.itemsize < 8, name, c)
    frame = pd.DataFrame({"row": np.arange(len(ra), dtype="int64"), "ra": ra.astype("float64"), "dec": dec.astype("float64")})
    return spark.createDataFrame(frame, "row long, ra double, dec double")


def _warn(low: bool, name: str, column: str) -> None:
    if low:
        warnings.warn(f"{name}: {column} has less than 64 bits; positions are only as exact as that", UserWarning, stacklevel=3)


def check_coordinates(catalogues: dict[str, DataFrame], unrolled: bool = False) -> dict[str, int]:
    """Rows of each catalogue; raises if a coordinate isn't finite or a declination lies beyond a pole.

    Unrolled declinations may lie there: they go on over the poles along a meridian (see ``operators/spatial``).
    One job for all catalogues.
    """
    parts = [df.select(F.lit(n).alias("name"), "ra", "dec") for n, df in catalogues.items()]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionAll(p)
    odd = lambda c: F.coalesce(F.isnan(c) | (F.abs(F.col(c)) == float("inf")), F.lit(True))
    got = every.groupBy("name").agg(F.count("*").alias("n"), F.count_if(odd("ra") | odd("dec")).alias("odd"), F.count_if(F.abs("dec") > 90.0).alias("far")).collect()
    counts = dict.fromkeys(catalogues, 0)
    for r in got:
        if r["odd"]:
            raise ValueError(f"{r['name']}: coordinates must be finite")
        if r["far"] and not unrolled:
            raise ValueError(f"{r['name']}: declinations must be within -90 and 90 degrees")
        counts[r["name"]] = r["n"]
    return counts


def with_vectors(df: DataFrame, *more: str) -> DataFrame:
    """``row, x, y, z`` of a catalogue, and more of its columns."""
    x, y, z = unit_vector(F.col("ra"), F.col("dec"))
    return df.select("row", x.alias("x"), y.alias("y"), z.alias("z"), *more)


def as_chunks(ra: Any, dec: Any, chunk_rows: int) -> Iterator[tuple[Any, Any]]:
    """Slices of two arrays; empty arrays give one empty slice."""
    if chunk_rows < 1:
        raise ValueError("chunk_rows must be at least 1")
    for a in range(0, max(1, len(ra)), chunk_rows):
        yield ra[a : a + chunk_rows], dec[a : a + chunk_rows]


def from_chunks(spark: SparkSession, chunks: Iterable[tuple[Any, Any]], name: str) -> DataFrame:
    """A catalogue of slices in arrival order."""
    out, first = None, 0
    for ra, dec in chunks:
        part = catalogue(spark, (ra, dec), name).withColumn("row", F.col("row") + first)
        first += len(ra)
        out = part if out is None else out.unionAll(part)
    return out if out is not None else spark.createDataFrame([], "row long, ra double, dec double")
