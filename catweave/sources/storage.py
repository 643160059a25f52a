"""Saved candidate edges, declination-band layouts, and results.

Edges are saved as three Parquet datasets partitioned by segment (``rows``, ``deduplication``, ``edges``) and a
``metadata.json``.  A segment is a slice of the sky that no connected group of rows leaves.
"""

from __future__ import annotations

import json
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterable, Mapping, Sequence
from itertools import combinations
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sphere import band_of
from ..operators.dedupe import dedupe_from_pairs
from ..operators.edges import EDGE_SCHEMA, OUTCOME_SCHEMA, CandidateEdges, EdgeSettings, build_edges, edge_settings, union
from ..operators.modes import CrossmatchModeConfig, labelled, node_edges
from ..operators.spatial import all_pairs, self_pairs
from ..plans.index import MatchIndex
from ..plans.match import resolve
from .catalog import catalogue, check_coordinates, from_chunks
from .shared import written

ROWS, DEDUPE, EDGES, METADATA = "rows", "deduplication", "edges", "metadata.json"
MOST_SLICES = 64


def write_text(spark: SparkSession, path: str, text: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    out.write(text.encode())
    out.close()


def read_text(spark: SparkSession, path: str) -> str:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(p)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def file_names(spark: SparkSession, directory: str) -> list[str]:
    """Names in a folder; none if there is no such folder."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(directory)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []


def check_segment_names(names: Iterable[str]) -> list[str]:
    names = list(names)
    for n in names:
        if not n or "/" in n or n.startswith(".") or n == METADATA:
            raise ValueError(f"segment name {n!r} can't be used")
    if len(set(names)) != len(names):
        raise ValueError("segment names must be unique")
    return names


def write_metadata(spark: SparkSession, directory: str, settings: EdgeSettings, n_rows: Mapping[str, int], segments: Iterable[str], extra: Mapping[str, Any] | None = None) -> None:
    value = {
        "surveys": [{"name": n, "n_rows": n_rows[n], "dedupe_radius_arcsec": settings.dedupe_radius[n]} for n in settings.surveys],
        "pairs": [{"surveys": list(p), "radius_arcsec": settings.pair_radius[frozenset(p)]} for p in combinations(settings.surveys, 2) if frozenset(p) in settings.pair_radius],
        "segments": check_segment_names(segments),
        **(extra or {}),
    }
    write_text(spark, f"{directory}/{METADATA}", json.dumps(value, indent=2))


def read_edges_metadata(spark: SparkSession, directory: str) -> dict[str, Any]:
    return json.loads(read_text(spark, f"{directory}/{METADATA}"))


def segment_names(spark: SparkSession, directory: str) -> list[str]:
    return read_edges_metadata(spark, directory)["segments"]


def _settings(meta: Mapping[str, Any]) -> EdgeSettings:
    return EdgeSettings(tuple(s["name"] for s in meta["surveys"]), {s["name"]: s["dedupe_radius_arcsec"] for s in meta["surveys"]}, {frozenset(p["surveys"]): p["radius_arcsec"] for p in meta["pairs"]})


def _write_parts(edges: CandidateEdges, directory: str, segment: F.Column | None, mode: str) -> None:
    for name, df, keys in ((ROWS, edges.rows, ["survey", "row"]), (DEDUPE, edges.outcomes, ["survey", F.desc("status"), "row"]), (EDGES, edges.edges, ["survey_a", "survey_b", "row_a", "row_b"])):
        # Rows of a segment come together, so that a task writes few files.
        df = df.repartitionByRange("segment", *keys) if segment is None else df.withColumn("segment", segment)
        df.sortWithinPartitions("segment", *keys).write.mode(mode).partitionBy("segment").parquet(f"{directory}/{name}")


def write_segment(edges: CandidateEdges, directory: str, name: str) -> None:
    """Write one segment, in place of what it held before; ``write_metadata`` afterwards names the segments."""
    check_segment_names([name])
    spark = edges.spark
    jvm = spark.sparkContext._jvm
    folder = f"segment={jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(name)}"
    for part in (ROWS, DEDUPE, EDGES):
        p = jvm.org.apache.hadoop.fs.Path(f"{directory}/{part}/{folder}")
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    _write_parts(edges, directory, F.lit(name), "append")


def write_edges(edges: CandidateEdges, directory: str) -> None:
    """Save as the single segment ``segment-0``."""
    write_segment(edges, directory, "segment-0")
    write_metadata(edges.spark, directory, edges.settings, {n: c["n_rows"] for n, c in edges.dedupe_counts.items()}, ["segment-0"])


def build_edges_to_directory(spark: SparkSession, coordinates: Mapping[str, Any], directory: str, **settings: Any) -> None:
    write_edges(build_edges(spark, coordinates, **settings), directory)


def _part(spark: SparkSession, directory: str, name: str, schema: str, segments: list[str] | None) -> DataFrame:
    if segments is not None and not segments:
        return spark.createDataFrame([], schema)
    df = spark.read.schema(f"{schema}, segment string").parquet(f"{directory}/{name}")
    return (df if segments is None else df.where(F.col("segment").isin(segments))).drop("segment")


def read_segment(spark: SparkSession, directory: str, name: str) -> CandidateEdges:
    meta = read_edges_metadata(spark, directory)
    if name not in meta["segments"]:
        raise ValueError(f"there is no segment {name!r}")
    return _read(spark, directory, meta, [name])


def read_segments(spark: SparkSession, directory: str, names: Sequence[str]) -> CandidateEdges:
    """Some segments together."""
    meta = read_edges_metadata(spark, directory)
    if strange := sorted(set(names) - set(meta["segments"])):
        raise ValueError(f"there are no segments {strange}")
    return _read(spark, directory, meta, list(names))


def read_edges(spark: SparkSession, directory: str) -> CandidateEdges:
    """All segments together; without any, edges that cover no rows."""
    meta = read_edges_metadata(spark, directory)
    return _read(spark, directory, meta, None if meta["segments"] else [])


def _read(spark: SparkSession, directory: str, meta: Mapping[str, Any], segments: list[str] | None) -> CandidateEdges:
    parts = [_part(spark, directory, n, s, segments) for n, s in ((ROWS, "survey string, row long"), (DEDUPE, OUTCOME_SCHEMA), (EDGES, EDGE_SCHEMA))]
    return CandidateEdges(spark, _settings(meta), *parts, segment=segments[0] if segments else None, is_stored=True)


def resolve_to_file(spark: SparkSession, directory: str, mode: CrossmatchModeConfig, path: str, *, sort: bool = True) -> MatchIndex:
    """Resolve saved edges and save the index, sorted by range over as many files as Spark makes."""
    index = resolve(read_edges(spark, directory), mode)
    (index.with_metadata() if sort else index.df).write.mode("overwrite").parquet(path)
    write_text(spark, f"{path}/_index.json", json.dumps(index.metadata))
    return index


def merged_metadata(summaries: list[Mapping[str, Any]]) -> dict[str, Any]:
    """One summary of several segments': counts add up, all else must agree."""
    out: dict[str, Any] = {}
    for s in summaries:
        for k, v in s.items():
            if k in out and (k.startswith("n_") or k.startswith("rows_in_")) and k != "n_rows":
                out[k] += v
            elif k in out and out[k] != v:
                raise ValueError(f"the segments disagree on {k}")
            else:
                out[k] = v
    return out


# Declination bands


def write_band_layout(spark: SparkSession, directory: str, surveys: Mapping[str, Any], *, band_height_deg: float, unrolled: bool = False) -> None:
    """Regroup catalogues by band; a survey is a frame, a pair of arrays, or an iterable of such pairs.

    ``unrolled`` lets declinations go on over the poles, with bands beyond those of the sphere.
    """
    if not band_height_deg > 0:
        raise ValueError("band_height_deg must be greater than 0")
    frames = {}
    for n, source in surveys.items():
        pair = isinstance(source, tuple) and len(source) == 2 and not (len(source[0]) and isinstance(source[0][0], tuple | list))
        frames[n] = catalogue(spark, source, n) if isinstance(source, DataFrame) or pair else from_chunks(spark, source, n)
    counts = check_coordinates(frames, unrolled)
    for n, df in frames.items():
        df = df.withColumn("band", band_of(F.col("dec"), band_height_deg))
        # Ranges of rows: a crowded band is spread over tasks, and a file holds many thin ones, however many there are.
        df.repartitionByRange("band", "row").sortWithinPartitions("band", "row").write.mode("overwrite").parquet(f"{directory}/{n}")
    write_text(spark, f"{directory}/layout.json", json.dumps({"band_height_deg": band_height_deg, "surveys": [{"name": n, "n_rows": counts[n]} for n in frames]}))


def read_layout(spark: SparkSession, directory: str) -> dict[str, Any]:
    return json.loads(read_text(spark, f"{directory}/layout.json"))


def read_bands(spark: SparkSession, directory: str, survey: str, bands: Iterable[int] | None = None) -> DataFrame:
    """``row, ra, dec, band``; of files and row groups that hold other bands only the footers are read."""
    df = spark.read.schema("row long, ra double, dec double, band long").parquet(f"{directory}/{survey}").select("row", "ra", "dec", "band")
    if isinstance(bands, range) and bands.step == 1:
        return df.where(F.col("band").between(bands.start, bands.stop - 1))
    return df if bands is None else df.where(F.col("band").isin(list(bands)))


def runs(items: list, n: int) -> list[list]:
    """At most ``n`` parts of a list, in order and about equal."""
    size = max(1, -(-len(items) // n))
    return [items[i : i + size] for i in range(0, len(items), size)]


def prepare_band_build(spark: SparkSession, layout: str, directory: str, **settings: Any) -> list[int]:
    """Check settings against a layout, record them, and name the bands to build."""
    laid = read_layout(spark, layout)
    plan = edge_settings([s["name"] for s in laid["surveys"]], **settings)
    if laid["band_height_deg"] <= plan.max_radius_arcsec * (1 + 1e-6) / 3600:
        raise ValueError("a band must be higher than the largest radius")
    bands = sorted({r[0] for s in laid["surveys"] if s["n_rows"] for r in read_bands(spark, layout, s["name"]).select("band").distinct().collect()})
    value = {
        "layout": layout, "band_height_deg": laid["band_height_deg"], "bands": bands, "surveys": laid["surveys"], "dedupe_radius": dict(plan.dedupe_radius),
        "pair_radius": [[sorted(p, key=plan.surveys.index), r] for p, r in plan.pair_radius.items()],
    }
    write_text(spark, f"{directory}/band-build.json", json.dumps(value))
    return bands


def _plan(spark: SparkSession, directory: str) -> tuple[dict[str, Any], EdgeSettings]:
    v = json.loads(read_text(spark, f"{directory}/band-build.json"))
    return v, EdgeSettings(tuple(s["name"] for s in v["surveys"]), v["dedupe_radius"], {frozenset(p): r for p, r in v["pair_radius"]})


PAIRS = "kind string, survey_a string, survey_b string, row_a long, row_b long, separation_arcsec double"


def _band_pairs(spark: SparkSession, plan: Mapping[str, Any], settings: EdgeSettings, bands: range | None) -> DataFrame:
    """All pairs a range of bands owns: those whose first row lies in it.

    The other rows come from the same bands and from the margin of the next ones that the radius reaches.
    """
    own = {s["name"]: read_bands(spark, plan["layout"], s["name"], bands) if s["n_rows"] else spark.createDataFrame([], "row long, ra double, dec double, band long") for s in plan["surveys"]}
    near = own
    if bands is not None:
        reach = range(bands.start - 1, bands.stop + 1)
        height, margin = plan["band_height_deg"], settings.max_radius_arcsec * (1 + 1e-6) / 3600 + 1e-9
        within = F.col("dec").between(bands.start * height - 90.0 - margin, bands.stop * height - 90.0 + margin)
        near = {s["name"]: read_bands(spark, plan["layout"], s["name"], reach).where(within) if s["n_rows"] else own[s["name"]] for s in plan["surveys"]}
    out = []
    for n, r in settings.dedupe_radius.items():
        if r:
            found = self_pairs(own[n], r) if bands is None else all_pairs(own[n], near[n], r).where("row_a < row_b")
            out.append(found.select(F.lit("self").alias("kind"), F.lit(n).alias("survey_a"), F.lit(n).alias("survey_b"), "row_a", "row_b", "separation_arcsec"))
    for a, b in combinations(settings.surveys, 2):
        if (p := frozenset((a, b))) in settings.pair_radius:
            out.append(all_pairs(own[a], near[b], settings.pair_radius[p]).select(F.lit("cross").alias("kind"), F.lit(a).alias("survey_a"), F.lit(b).alias("survey_b"), "row_a", "row_b", "separation_arcsec"))
    return union(out, spark, PAIRS)


def build_band(spark: SparkSession, directory: str, band: int) -> None:
    """One task of a build spread over processes: the pairs that a band owns, in any order of bands."""
    build_bands(spark, directory, [band])


def build_bands(spark: SparkSession, directory: str, bands: Sequence[int]) -> None:
    """The same for some bands that follow each other in the build's list, as one plan."""
    plan, settings = _plan(spark, directory)
    bands = list(bands)
    if not bands or bands != [b for b in plan["bands"] if bands[0] <= b <= bands[-1]]:
        raise ValueError("bands are built in runs of the list that prepare_band_build gave")
    _band_pairs(spark, plan, settings, range(bands[0], bands[-1] + 1)).write.mode("overwrite").parquet(f"{directory}/.handovers/bands-{bands[0]}_{bands[-1]}")


def _handovers(spark: SparkSession, directory: str, bands: list[int]) -> list[str]:
    """The folders of what was built; every band must be in one of them and in no other."""
    built = sorted((tuple(map(int, n.removeprefix("bands-").split("_"))), n) for n in file_names(spark, f"{directory}/.handovers") if n.startswith("bands-"))
    held = Counter(b for (low, high), _ in built for b in bands[bisect_left(bands, low) : bisect_right(bands, high)])
    if wrong := [b for b in bands if held[b] != 1]:
        raise ValueError(f"{len(wrong)} bands are not built, or in several runs, such as {wrong[:5]}")
    return [f"{directory}/.handovers/{n}" for _, n in built]


def sweep_boundaries(spark: SparkSession, directory: str, *, max_carried_rows: int | None = None) -> None:
    """Join the bands' pairs, decide duplicates, and write each group of rows into one segment.

    A group within one slice of bands goes to ``band-k`` of the slice's first band, one that crosses slices to
    ``boundary-k`` of its last slice.  A slice is one band unless there are more than ``MOST_SLICES``.
    More than ``max_carried_rows`` rows in groups that cross one boundary raise ``RuntimeError``.
    """
    plan, settings = _plan(spark, directory)
    pairs = spark.read.schema(PAIRS).parquet(*_handovers(spark, directory, plan["bands"])) if plan["bands"] else spark.createDataFrame([], PAIRS)
    _finish(spark, directory, plan, settings, pairs, max_carried_rows)
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{directory}/.handovers")
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _finish(spark: SparkSession, directory: str, plan: Mapping[str, Any], settings: EdgeSettings, pairs: DataFrame, max_carried_rows: int | None) -> None:
    names = settings.surveys
    frames = [read_bands(spark, plan["layout"], s["name"]).select(F.lit(s["name"]).alias("survey"), "row", "band") for s in plan["surveys"] if s["n_rows"]]
    placed = union(frames, spark, "survey string, row long, band long")
    rows = placed.select("survey", "row")
    judged = [dedupe_from_pairs(pairs.where((F.col("kind") == "self") & (F.col("survey_a") == n))).select(F.lit(n).alias("survey"), "row", "status", "kept_row") for n, r in settings.dedupe_radius.items() if r]
    outcomes = written(union(judged, spark, OUTCOME_SCHEMA), "outcomes")
    gone = outcomes.select("survey", "row")
    cross = pairs.where("kind = 'cross'").drop("kind")
    for s in "ab":
        cross = cross.join(gone.select(F.col("survey").alias(f"survey_{s}"), F.col("row").alias(f"row_{s}")), [f"survey_{s}", f"row_{s}"], "left_anti")
    cross = written(cross.select("survey_a", "survey_b", "row_a", "row_b", "separation_arcsec"), "cross")
    edges = CandidateEdges(spark, settings, rows, outcomes, cross)
    group = labelled(node_edges(CandidateEdges(spark, settings, rows, outcomes, pairs.drop("kind"))))[0].select("node", "component")
    place = F.create_map(*(x for i, n in enumerate(names) for x in (F.lit(n), F.lit(i).cast("long"))))
    at = placed.withColumn("node", F.shiftleft(place[F.col("survey")], 48) + F.col("row")).join(group, "node", "left")
    span = at.where("component IS NOT NULL").groupBy("component").agg(F.min("band").alias("low"), F.max("band").alias("high"))
    at = at.join(span, "component", "left")
    if max_carried_rows is not None:
        carried = at.where("low < high AND band < high").select(F.explode(F.sequence("band", F.col("high") - 1)).alias("edge")).groupBy("edge").count()
        worst = carried.agg(F.max("count")).first()[0] or 0
        if worst > max_carried_rows:
            raise RuntimeError(f"groups that are not finished take {worst} rows over one band boundary, more than the {max_carried_rows} allowed: at this density the radii link nearly everything")
    first, last = (plan["bands"][0], plan["bands"][-1]) if plan["bands"] else (0, 0)
    width = (last - first) // MOST_SLICES + 1
    cut = lambda c: F.floor((F.col(c) - first) / width).cast("long") * width + first
    name = F.when(cut("low") < cut("high"), F.concat(F.lit("boundary-"), cut("high").cast("string"))).otherwise(F.concat(F.lit("band-"), cut("band").cast("string")))
    named = written(at.select("survey", "row", name.alias("segment")), "segments")
    put = CandidateEdges(
        spark, settings, named, outcomes.join(named, ["survey", "row"]).select("survey", "row", "status", "kept_row", "segment"),
        cross.join(named.select(F.col("survey").alias("survey_a"), F.col("row").alias("row_a"), "segment"), ["survey_a", "row_a"]).select(*edges.edges.columns, "segment"),
    )
    _write_parts(put, directory, None, "overwrite")
    # Two names a slice at most.
    segments = sorted((r[0] for r in named.select("segment").distinct().collect()), key=lambda s: (s.rpartition("-")[0], int(s.rpartition("-")[2])))
    write_metadata(spark, directory, settings, {s["name"]: s["n_rows"] for s in plan["surveys"]}, segments, {"band_height_deg": plan["band_height_deg"]})


def build_edges_by_band(spark: SparkSession, layout: str, directory: str, *, max_carried_rows: int | None = None, **settings: Any) -> None:
    """The whole build as one plan over all bands."""
    prepare_band_build(spark, layout, directory, **settings)
    plan, checked = _plan(spark, directory)
    pairs = written(_band_pairs(spark, plan, checked, None), "pairs")
    _finish(spark, directory, plan, checked, pairs, max_carried_rows)

