"""Queries over the test tables, and the same in SQL for DuckDB.

The tables hold no coordinates, so three catalogues are derived from order keys by arithmetic that every
engine does alike: A from orders, B and C from first and second lines of orders, with jitter.  They lie on a
strip along a meridian, which large keys take over the poles: declinations are unrolled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sphere import band_of, direction, unit_vector
from ..operators.dedupe import dedupe_survey
from ..operators.edges import CandidateEdges, build_edges, combine_segments
from ..operators.graph import signatures
from ..operators.hub import SpatialLink, UIDLink, match_hub_and_spoke
from ..operators.modes import DegenerateCrossmatchConfig, EntitySelectionConfig, EntitywiseCrossmatchConfig, node_edges
from ..operators.policies import POLICIES, one_to_one_pairs
from ..operators.spatial import all_pairs, self_pairs
from ..operators.uids import match_uids
from ..sources.shared import numbered, scratch
from ..sources.storage import build_bands, build_edges_by_band, prepare_band_build, read_bands, read_edges, read_segments, runs, segment_names, sweep_boundaries, write_band_layout, write_edges
from .audit import component_facts, duplicate_groups, pair_facts
from .index import column, ids_to_rows, rows_to_ids
from .match import crossmatch, resolve

Query = Callable[[SparkSession, str], DataFrame]
SETTINGS = {"radius_arcsec": 1.0, "dedupe_radius_arcsec": 0.4, "dedupe_radius_arcsec_overrides": {"a": 0.0}, "radius_arcsec_overrides": {("a", "c"): 0.8}, "check": False}
LINES = {"b": (1, (31337, 2003, 7331, 1999)), "c": (2, (4241, 2011, 9137, 1997))}
ORDER = ["l_orderkey", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _position(k: F.Column, jra: F.Column, jdec: F.Column) -> tuple[F.Column, F.Column]:
    one = lambda x: F.lit(float(x))
    ra = one(150) + (k * 7919) % 1000003 / one(1000003) * one(0.13) + jra / one(3600)
    dec = one(-60) + F.floor(k / one(4096)) * one(0.2) + (k * 104729) % 1000033 / one(1000033) * one(0.13) + jdec / one(3600)
    return ra.alias("ra"), dec.alias("dec")


def catalogue_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """``row, ra, dec`` and the key it was made from."""
    if name == "a":
        orders = numbered(spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("key")), "row", "key")
        return orders.select("row", *_position(F.col("key"), F.lit(0.0), F.lit(0.0)), "key")
    line, (m1, p1, m2, p2) = LINES[name]
    rows = numbered(spark.read.parquet(f"{sf_dir}/lineitem.parquet").where(F.col("l_linenumber") == line).select(*ORDER), "row", *ORDER)
    jitter = [(F.col("l_partkey") * m) % p / F.lit(float(p)) * F.lit(0.8) - F.lit(0.4) for m, p in ((m1, p1), (m2, p2))]
    return rows.select("row", *_position(F.col("l_orderkey"), *jitter), F.col("l_orderkey").alias("key"))


def _catalogues(spark: SparkSession, sf_dir: str, names: str) -> dict[str, DataFrame]:
    return {n: catalogue_of(spark, sf_dir, n).select("row", "ra", "dec") for n in names}


def _edges(spark: SparkSession, sf_dir: str, names: str = "abc") -> CandidateEdges:
    settings = SETTINGS if names == "abc" else {**SETTINGS, "radius_arcsec_overrides": {}, "dedupe_radius_arcsec_overrides": {n: 0.0 for n in names if n == "a"}}
    return build_edges(spark, _catalogues(spark, sf_dir, names), **settings)


def _sep(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*(F.col(c).alias(n) for c, n in zip(("row_a", "row_b"), names)), F.round("separation_arcsec", 4).alias("sep"))


def _plain(df: DataFrame) -> DataFrame:
    """Row columns under plain names, separations rounded."""
    short = lambda c: c.replace("/row_index", "_row").replace("/separation_arcsec", "_sep").replace("+", "_")
    return df.select(*((F.round(column(c).cast("double"), 3) if "separation" in c else column(c)).alias(short(c)) for c in df.columns))


def _pairs_query(a: str, b: str, radius: float, k: int | None = None) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        c = _catalogues(spark, sf_dir, a + b)
        return _sep(all_pairs(c[a], c[b], radius, k), f"{a}_row", f"{b}_row")

    return run


def _policy_query(policy: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        c = _catalogues(spark, sf_dir, "ab")
        return _sep(one_to_one_pairs(all_pairs(c["a"], c["b"], 1.0), policy), "a_row", "b_row")

    return run


def _degenerate_query(policy: str, surveys: str) -> Query:
    return lambda spark, sf_dir: _plain(resolve(_edges(spark, sf_dir), DegenerateCrossmatchConfig(tuple(surveys), policy)).df)


def _entity_query(**mode) -> Query:
    return lambda spark, sf_dir: _plain(resolve(_edges(spark, sf_dir), EntitywiseCrossmatchConfig(**mode)).df)


def xyz_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y, z = unit_vector(F.col("ra"), F.col("dec"))
    return catalogue_of(spark, sf_dir, "a").select("row", F.round(x, 9).alias("x"), F.round(y, 9).alias("y"), F.round(z, 9).alias("z"))


def xyz_to_radec_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    ra, dec = direction(*unit_vector(F.col("ra"), F.col("dec")))
    return catalogue_of(spark, sf_dir, "b").select("row", F.round(ra, 8).alias("ra"), F.round(dec, 8).alias("dec"))


def band_layout_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue_of(spark, sf_dir, "b").groupBy(band_of(F.col("dec"), 0.05).alias("band")).agg(F.count("*").alias("n_rows"))


def self_pairs_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sep(self_pairs(_catalogues(spark, sf_dir, "b")["b"], 0.4), "first_row", "second_row")


def dedupe_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe_survey(_catalogues(spark, sf_dir, "b")["b"], 0.4)


def candidate_edges_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir).edges.select("survey_a", "survey_b", "row_a", "row_b", F.round("separation_arcsec", 4).alias("sep"))


def clique_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signatures(node_edges(_edges(spark, sf_dir))).select("node", F.size("signature").alias("n_linked"), F.element_at("signature", 1).alias("lowest"), "is_clique")


def components_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = component_facts(_edges(spark, sf_dir))
    return facts.groupBy(F.least("n", F.lit(6)).alias("size"), F.col("bits").alias("survey_bits"), "is_clique").agg(F.count("*").alias("n_components"), F.sum("n").alias("n_rows"))


def audit_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_facts(_edges(spark, sf_dir)).drop("percentiles")


def audit_surveys(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _edges(spark, sf_dir)
    per = edges.rows.groupBy("survey").agg(F.count("*").alias("n_rows"))
    out = edges.outcomes.groupBy("survey").agg(F.count_if(F.col("status") == "dropped").alias("n_dropped"), F.count_if(F.col("status") == "disputed").alias("n_disputed"))
    full = per.join(out, "survey", "left").join(duplicate_groups(edges), "survey", "left")
    return full.select("survey", "n_rows", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_dropped", "n_disputed", "n_duplicate_groups", "largest_duplicate_group")))


def separation_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_facts(_edges(spark, sf_dir)).select("survey_a", "survey_b", *(F.round(F.col("percentiles")[i], 4).alias(f"p{p}") for i, p in enumerate((5, 25, 50, 75, 95))))


def _keys(spark: SparkSession, sf_dir: str, table: str, key: str) -> DataFrame:
    return numbered(spark.read.parquet(f"{sf_dir}/{table}.parquet").select(F.expr(key).alias("uid")).distinct(), "row", "uid")


#: Every other key above all signed 64-bit numbers.
_HIGH = "CAST(CAST({0} AS DECIMAL(20,0)) + CASE WHEN {0} % 2 = 1 THEN 9223372036854775808 ELSE 0 END AS DECIMAL(20,0))"
#: name: (sources as (name, table, key), join, anchor)
UIDS = {
    "uid_inner": ((("d", "documents", "doc_id"), ("l", "labels", "doc_id")), "inner", None),
    "uid_left": ((("d", "documents", "doc_id"), ("l", "labels", "doc_id")), "left", None),
    "uid_outer": ((("c", "customer", "c_custkey"), ("o", "orders", "o_custkey")), "outer", None),
    "uid_outer_anchor_b": ((("p", "part", "p_partkey"), ("l", "lineitem", "l_partkey")), "outer", "l"),
    "uid_three_way_outer": ((("c", "customer", "c_custkey"), ("s", "supplier", "s_suppkey"), ("p", "part", "p_partkey")), "outer", None),
    "uid_string_inner": ((("c", "customer", "CAST(c_custkey AS STRING)"), ("o", "orders", "CAST(o_custkey AS STRING)")), "inner", None),
    "uid_uint64": ((("c", "customer", _HIGH.format("c_custkey")), ("o", "orders", _HIGH.format("o_custkey"))), "left", None),
    "uid_checked": ((("l", "labels", "doc_id"), ("d", "documents", "doc_id")), "outer", "d"),
}


def _uid_query(name: str) -> Query:
    sources, join, anchor = UIDS[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _plain(match_uids(spark, {n: _keys(spark, sf_dir, t, k) for n, t, k in sources}, join=join, anchor=anchor, check=name == "uid_checked").df)

    return run


def rows_to_ids_ab(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = {n: catalogue_of(spark, sf_dir, n).select("row", F.col("key").alias("id")) for n in "ab"}
    index = resolve(_edges(spark, sf_dir, "ab"), EntitywiseCrossmatchConfig())
    return rows_to_ids(index, ids, id_columns={"a": "a_id", "b": "b_id"})


def ids_to_rows_ab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """There and back through ids that are unique: a row's number as text."""
    ids = {n: catalogue_of(spark, sf_dir, n).select("row", F.concat(F.lit(n), F.col("row").cast("string")).alias("id")) for n in "ab"}
    index = resolve(_edges(spark, sf_dir, "ab"), DegenerateCrossmatchConfig(("a", "b")))
    return _plain(ids_to_rows(rows_to_ids(index, ids), ids))


def hub_uid_spatial(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = catalogue_of(spark, sf_dir, "a")
    uids = {"a": a.select("row", F.col("key").alias("uid")), "k": _keys(spark, sf_dir, "lineitem", "l_orderkey")}
    coordinates = {"a": a.select("row", "ra", "dec"), **_catalogues(spark, sf_dir, "b")}
    return _plain(match_hub_and_spoke(spark, anchor="a", links={"k": UIDLink(), "b": SpatialLink(1.0)}, coordinates=coordinates, uids=uids, dedupe_radius_arcsec=0.0, check=False).df)


def hub_two_spatial(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = {"b": SpatialLink(1.0, "anchored_nearest"), "c": SpatialLink(0.8)}
    return _plain(match_hub_and_spoke(spark, anchor="a", links=links, coordinates=_catalogues(spark, sf_dir, "abc"), dedupe_radius_arcsec=0.0, check=False).df)


def entity_sorted_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = resolve(_edges(spark, sf_dir), EntitywiseCrossmatchConfig())
    keyed = index.df.select(index.sort_keys[0].alias("_k"), index.sort_keys[1].alias("_r"), *(column(c) for c in index.df.columns))
    return _plain(numbered(keyed, "ordinal", "_k", "_r").drop("_k", "_r"))


def saved_edges_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "edges")
    write_edges(_edges(spark, sf_dir), path)
    return _plain(resolve(read_edges(spark, path), DegenerateCrossmatchConfig(("a", "b", "c"))).df)


def banded_equals_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    layout, path = scratch(spark, "layout"), scratch(spark, "edges")
    write_band_layout(spark, layout, _catalogues(spark, sf_dir, "abc"), band_height_deg=0.01, unrolled=True)
    build_edges_by_band(spark, layout, path, **{k: v for k, v in SETTINGS.items() if k != "check"})
    return _plain(resolve(read_edges(spark, path), EntitywiseCrossmatchConfig()).df)


def bands_swept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bands built in eight runs by themselves, then swept; segments read back in four parts."""
    layout, path = scratch(spark, "layout"), scratch(spark, "edges")
    write_band_layout(spark, layout, _catalogues(spark, sf_dir, "abc"), band_height_deg=0.2, unrolled=True)
    bands = prepare_band_build(spark, layout, path, **{k: v for k, v in SETTINGS.items() if k != "check"})
    for run in runs(bands, 8):
        build_bands(spark, path, run)
    sweep_boundaries(spark, path)
    segments = [read_segments(spark, path, names) for names in runs(segment_names(spark, path), 4)]
    return _plain(resolve(combine_segments(segments), EntitywiseCrossmatchConfig()).df)


def crossmatch_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(crossmatch(spark, _catalogues(spark, sf_dir, "abc"), mode=EntitywiseCrossmatchConfig(), unrolled=True, **{**SETTINGS, "check": True}).df)


def band_read_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    layout = scratch(spark, "layout")
    write_band_layout(spark, layout, _catalogues(spark, sf_dir, "b"), band_height_deg=0.05, unrolled=True)
    return read_bands(spark, layout, "b", range(600, 603)).groupBy("band").agg(F.count("*").alias("n_rows"), F.min("row").alias("first_row"), F.max("row").alias("last_row"))


def queries() -> dict[str, Query]:
    plain = (
        xyz_projection, xyz_to_radec_roundtrip, band_layout_counts, self_pairs_b, dedupe_b, candidate_edges_active, clique_signatures, components_census, audit_pairs,
        audit_surveys, separation_percentiles, rows_to_ids_ab, ids_to_rows_ab, hub_uid_spatial, hub_two_spatial, entity_sorted_index, saved_edges_roundtrip,
        banded_equals_memory, bands_swept, crossmatch_entities, band_read_pruned,
    )
    out: dict[str, Query] = {f.__name__: f for f in plain}
    out |= {"all_pairs_ab": _pairs_query("a", "b", 1.0), "all_pairs_ac_override": _pairs_query("a", "c", 0.8)}
    out |= {f"all_pairs_k{k}": _pairs_query("a", "b", 1.0, k) for k in (1, 2)}
    out |= {f"policy_{p}": _policy_query(p) for p in POLICIES}
    out |= {f"degenerate_abc_{p}": _degenerate_query(p, "abc") for p in ("mutual_nearest", "mutual_unique")}
    out |= {"degenerate_swapped_order": _degenerate_query("mutual_nearest", "ba"), "degenerate_anchored_nearest": _degenerate_query("anchored_nearest", "ab")}
    out |= {"entity_refuse": _entity_query(), "entity_refuse_drop": _entity_query(disputed="drop")}
    out["entity_refuse_selection"] = _entity_query(selection=EntitySelectionConfig(2, ("a",)))
    out |= {"entity_split": _entity_query(resolver="split"), "entity_sequential": _entity_query(resolver="sequential", priority=("b", "a", "c")), "entity_split_cap3": _entity_query(resolver="split", size_cap=3)}
    out |= {n: _uid_query(n) for n in UIDS}
    return out


# The same in SQL

_CAT = """{n} AS (SELECT row_number() OVER (ORDER BY {order}) - 1 AS row, {k} AS key,
 (150::DOUBLE) + (({k}*7919) % 1000003)/(1000003::DOUBLE)*(0.13::DOUBLE) + {jra}/(3600::DOUBLE) AS ra,
 (-60::DOUBLE) + floor({k}/(4096::DOUBLE))*(0.2::DOUBLE) + (({k}*104729) % 1000033)/(1000033::DOUBLE)*(0.13::DOUBLE) + {jdec}/(3600::DOUBLE) AS dec
 FROM {source})"""


def _cats(names: str) -> str:
    out = []
    for n in names:
        if n == "a":
            out.append(_CAT.format(n=n, order="o_orderkey", k="o_orderkey", jra="0::DOUBLE", jdec="0::DOUBLE", source="orders"))
        else:
            line, (m1, p1, m2, p2) = LINES[n]
            jra, jdec = (f"((l_partkey*{m}) % {p} / ({p}::DOUBLE) * (0.8::DOUBLE) - (0.4::DOUBLE))" for m, p in ((m1, p1), (m2, p2)))
            out.append(_CAT.format(n=n, order=", ".join(ORDER), k="l_orderkey", jra=jra, jdec=jdec, source=f"lineitem WHERE l_linenumber = {line}"))
        out.append(f"{n}x AS (SELECT row, cos(radians(dec))*cos(radians(ra)) AS x, cos(radians(dec))*sin(radians(ra)) AS y, sin(radians(dec)) AS z, floor(dec*450)::BIGINT AS zone FROM {n})")
    return ",\n".join(out)


def _near(name: str, a: str, b: str, radius: float, where: str = "") -> str:
    """Pairs ``i, j, sep`` by declination zones of eight arcseconds."""
    c = f"(2*sin({radius}::DOUBLE*pi()/648000/2))"
    d2 = "((p.x-q.x)*(p.x-q.x)+(p.y-q.y)*(p.y-q.y)+(p.z-q.z)*(p.z-q.z))"
    return (
        f"{name} AS (SELECT p.row AS i, q.row AS j, 2*asin(least(1.0::DOUBLE, sqrt({d2})/2))*648000/pi() AS sep FROM (SELECT *, unnest([zone-1, zone, zone+1]) AS zz FROM {a}x) p "
        f"JOIN {b}x q ON p.zz = q.zone WHERE {d2} <= {c}*{c} {where})"
    )


def _dedupe(n: str, radius: float) -> str:
    return f"""{_near(f"{n}s", n, n, radius, "AND p.row < q.row")},
{n}n AS (SELECT i AS n, j AS m FROM {n}s UNION ALL SELECT j, i FROM {n}s UNION ALL SELECT i, i FROM {n}s UNION ALL SELECT j, j FROM {n}s),
{n}g AS (SELECT n, list_sort(list_distinct(list(m))) AS sig FROM {n}n GROUP BY n),
{n}q AS (SELECT n, sig, count(*) OVER (PARTITION BY sig) = len(sig) AS clique FROM {n}g),
{n}o AS (SELECT n AS row, CASE WHEN clique THEN 'dropped' ELSE 'disputed' END AS status, CASE WHEN clique THEN sig[1] END AS kept_row FROM {n}q WHERE NOT clique OR sig[1] <> n)"""


def _active_edges(names: str = "abc") -> str:
    """Catalogues, outcomes ``bo``/``co``, edges of active rows ``ab``/``ac``/``bc``, and ``e`` over all."""
    out = [_cats(names), *(_dedupe(n, 0.4) for n in names if n != "a")]
    every = []
    for a, b, r in (("a", "b", 1.0), ("a", "c", 0.8), ("b", "c", 1.0)):
        if a in names and b in names:
            out.append(_near(f"{a}{b}0", a, b, r))
            keep = [f"{side} NOT IN (SELECT row FROM {n}o)" for side, n in (("i", a), ("j", b)) if n != "a"]
            out.append(f"{a}{b} AS (SELECT * FROM {a}{b}0 WHERE {' AND '.join(keep)})")
            every.append(f"SELECT '{a}' AS survey_a, '{b}' AS survey_b, i AS row_a, j AS row_b, sep, i + {names.index(a) << 48} AS u, j + {names.index(b) << 48} AS v FROM {a}{b}")
    out.append(f"e AS ({' UNION ALL '.join(every)})")
    active = [f"SELECT row + {names.index(n) << 48} AS node FROM {n}" + ("" if n == "a" else f" WHERE row NOT IN (SELECT row FROM {n}o)") for n in names]
    out.append(f"act AS ({' UNION ALL '.join(active)})")
    out.append(
        "nb AS (SELECT u AS n, v AS m FROM e UNION ALL SELECT v, u FROM e UNION ALL SELECT u, u FROM e UNION ALL SELECT v, v FROM e), "
        "sg AS (SELECT n AS node, list_sort(list_distinct(list(m))) AS sig FROM nb GROUP BY n), "
        "sq AS (SELECT node, sig, count(*) OVER (PARTITION BY sig) = len(sig) AS clique FROM sg)"
    )
    return ",\n".join(out)


def _policy(name: str, pairs: str, policy: str) -> str:
    kind = "row_number() OVER (PARTITION BY {o} ORDER BY sep, {x}) = 1" if policy.endswith("nearest") else "count(*) OVER (PARTITION BY {o}) = 1"
    own, back = kind.format(o="i", x="j"), kind.format(o="j", x="i")
    keep = "k1 AND k2" if policy.startswith("mutual") else "k1"
    return f"{name} AS (SELECT i, j, sep FROM (SELECT *, {own} AS k1, {back} AS k2 FROM {pairs}) WHERE {keep})"


def _entities(names: str = "abc") -> str:
    """``ent``: row columns and reason of every entity under the refuse resolver."""
    spread = lambda f: ", ".join(f"{f}(CASE WHEN node >> 48 = {i} THEN node & {(1 << 48) - 1} END) AS {n}_row" for i, n in enumerate(names))
    single = " UNION ALL ".join(
        ["SELECT node, NULL AS why FROM act WHERE node NOT IN (SELECT node FROM sg)", "SELECT node, 'ambiguous_component' FROM sq WHERE NOT clique"]
        + [f"SELECT row + {names.index(n) << 48}, 'dedupe_disputed' FROM {n}o WHERE status = 'disputed'" for n in names if n != "a"]
    )
    return f"""{_active_edges(names)},
ent AS (SELECT {spread("max")}, NULL::VARCHAR AS disputed_reason FROM sq WHERE clique GROUP BY sig[1]
 UNION ALL SELECT {spread("")}, why AS disputed_reason FROM ({single}))"""


def _resolved(grouped: str, size_cap: int = 30, names: str = "abc") -> str:
    """``ent`` under a resolver.  ``grouped`` makes ``fin(node, grp)`` from ``odd(comp, node)``, the nodes of
    ambiguous components up to the cap, and ``ee(u, v, sep)``, the edges between them in both directions."""
    spread = lambda f: ", ".join(f"{f}(CASE WHEN node >> 48 = {i} THEN node & {(1 << 48) - 1} END) AS {n}_row" for i, n in enumerate(names))
    single = " UNION ALL ".join(
        ["SELECT node, NULL AS why FROM act WHERE node NOT IN (SELECT node FROM sg)", f"SELECT node, 'ambiguous_component' FROM lab WHERE size > {size_cap}"]
        + [f"SELECT row + {names.index(n) << 48}, 'dedupe_disputed' FROM {n}o WHERE status = 'disputed'" for n in names if n != "a"]
    )
    return f"""WITH RECURSIVE {_active_edges(names)},
on_ AS (SELECT n, m FROM nb WHERE n IN (SELECT node FROM sq WHERE NOT clique)),
walk(node, m) AS (SELECT n, m FROM on_ UNION SELECT w.node, o.m FROM walk w JOIN on_ o ON o.n = w.m),
lab AS MATERIALIZED (SELECT node, comp, count(*) OVER (PARTITION BY comp) AS size FROM (SELECT node, min(m) AS comp FROM walk GROUP BY node)),
odd AS MATERIALIZED (SELECT comp, node FROM lab WHERE size <= {size_cap}),
ee AS MATERIALIZED (SELECT u, v, sep FROM e WHERE u IN (SELECT node FROM odd) UNION ALL SELECT v, u, sep FROM e WHERE u IN (SELECT node FROM odd)),
{grouped},
ent AS (SELECT {spread("max")}, NULL::VARCHAR AS disputed_reason FROM sq WHERE clique GROUP BY sig[1]
 UNION ALL SELECT {spread("max")}, NULL FROM fin GROUP BY grp
 UNION ALL SELECT {spread("")}, why AS disputed_reason FROM ({single}))
SELECT * FROM ent"""


#: One merge a component and round: the complete pair of groups with the least worst separation.
_SPLIT = """st(it, comp, node, grp) AS (
 SELECT 0, comp, node, node FROM odd
 UNION ALL
 SELECT s.it + 1, s.comp, s.node, CASE WHEN s.grp = b.h THEN b.g ELSE s.grp END FROM st s JOIN (
  SELECT comp, g, h FROM (
   SELECT comp, g, h, row_number() OVER (PARTITION BY comp ORDER BY worst, merged) AS k FROM (
    SELECT p.comp, p.grp AS g, q.grp AS h, max(ee.sep) AS worst, list_sort(list_distinct(list_concat(list(p.node), list(q.node)))) AS merged
    FROM st p JOIN st q ON p.comp = q.comp AND p.grp < q.grp LEFT JOIN ee ON ee.u = p.node AND ee.v = q.node
    GROUP BY p.comp, p.grp, q.grp HAVING count(ee.sep) = count(*))) WHERE k = 1) b ON b.comp = s.comp),
fin AS (SELECT node, arg_max(grp, it) AS grp FROM st GROUP BY node)"""


def _sequential(ranks: list[int]) -> str:
    """One placing a component and round: the best offer of the step, or, without one, the rest found groups."""
    rank = "CASE s.node >> 48 " + " ".join(f"WHEN {s} THEN {k}" for k, s in enumerate(ranks)) + " END"
    return f"""st(it, step, comp, node, grp, placed) AS (
 SELECT 0, 0, comp, node, NULL::BIGINT, NULL::INT FROM odd
 UNION ALL
 SELECT s.it + 1, s.step + CASE WHEN b.node IS NULL THEN 1 ELSE 0 END, s.comp, s.node,
  CASE WHEN s.node = b.node THEN b.g WHEN b.node IS NULL AND s.grp IS NULL AND {rank} = s.step THEN (s.step::BIGINT << 60) + s.node ELSE s.grp END,
  CASE WHEN s.node = b.node OR b.node IS NULL AND s.grp IS NULL AND {rank} = s.step THEN s.step ELSE s.placed END
 FROM st s LEFT JOIN (
  SELECT comp, node, g FROM (
   SELECT comp, node, g, row_number() OVER (PARTITION BY comp ORDER BY worst, node, g) AS k FROM (
    SELECT s.comp, s.node, q.grp AS g, max(ee.sep) AS worst
    FROM st s JOIN st q ON q.comp = s.comp AND q.grp IS NOT NULL LEFT JOIN ee ON ee.u = s.node AND ee.v = q.node
    WHERE s.grp IS NULL AND {rank} = s.step GROUP BY s.comp, s.node, q.grp HAVING count(ee.sep) = count(*) AND max(q.placed) < any_value(s.step))) WHERE k = 1) b ON b.comp = s.comp
 WHERE s.step < {len(ranks)}),
fin AS (SELECT node, arg_max(grp, it) AS grp FROM st WHERE grp IS NOT NULL GROUP BY node)"""


def _uid_sql(name: str) -> str:
    sources, join, anchor = UIDS[name]
    names = [s[0] for s in sources]
    order = [anchor or names[0], *(n for n in names if n != (anchor or names[0]))]
    ctes = [f"{n} AS (SELECT row_number() OVER (ORDER BY uid) - 1 AS row, uid FROM (SELECT DISTINCT {k} AS uid FROM {t}))" for n, t, k in sources]
    join_all = f"{names[0]}" + "".join(f" FULL JOIN {n} USING (uid)" for n in names[1:])
    where = {"inner": " AND ".join(f"{n}_row IS NOT NULL" for n in names), "left": f"{order[0]}_row IS NOT NULL", "outer": "TRUE"}[join]
    first = "CASE " + " ".join(f"WHEN {n}_row IS NOT NULL THEN {i}" for i, n in enumerate(order)) + " END"
    cols = ", ".join(f"{n}_row" for n in names)
    return (
        f"WITH {', '.join(ctes)}, j AS (SELECT {', '.join(f'{n}.row AS {n}_row' for n in names)} FROM {join_all}) "
        f"SELECT row_number() OVER (ORDER BY {first}, coalesce({', '.join(f'{n}_row' for n in order)})) - 1 AS entity_id, {cols} FROM j WHERE {where}"
    )


_DEGENERATE = (
    "SELECT mab.i AS a_row, mab.j AS b_row, mac.j AS c_row, round(mab.sep::FLOAT::DOUBLE, 3) AS a_b_sep, round(mac.sep::FLOAT::DOUBLE, 3) AS a_c_sep, "
    "round(mbc.sep::FLOAT::DOUBLE, 3) AS b_c_sep FROM mab JOIN mac ON mab.i = mac.i JOIN mbc ON mbc.i = mab.j AND mbc.j = mac.j"
)


def oracle_sql() -> dict[str, str]:
    pairs = "SELECT i AS a_row, j AS b_row, round(sep, 4) AS sep FROM "
    ab = f"WITH {_cats('ab')}, {_near('p', 'a', 'b', 1.0)}"
    edges, entities = f"WITH RECURSIVE {_active_edges()}", f"WITH RECURSIVE {_entities()}"
    three = {p: f"WITH {_active_edges()}, {_policy('mab', 'ab', p)}, {_policy('mac', 'ac', p)}, {_policy('mbc', 'bc', p)} {_DEGENERATE}" for p in ("mutual_nearest", "mutual_unique")}
    reach = "walk(node, m) AS (SELECT n, m FROM nb UNION SELECT w.node, nb.m FROM walk w JOIN nb ON nb.n = w.m), comp AS (SELECT node, min(m) AS component FROM walk GROUP BY node)"
    out = {
        "xyz_projection": f"WITH {_cats('a')} SELECT row, round(x, 9) AS x, round(y, 9) AS y, round(z, 9) AS z FROM ax",
        "xyz_to_radec_roundtrip": f"WITH {_cats('b')} SELECT row, round(CASE WHEN degrees(atan2(y, x)) < 0 THEN degrees(atan2(y, x)) + 360 ELSE degrees(atan2(y, x)) END, 8) AS ra, round(degrees(asin(z)), 8) AS dec FROM bx",
        "band_layout_counts": f"WITH {_cats('b')} SELECT floor((dec + 90)/(0.05::DOUBLE))::BIGINT AS band, count(*) AS n_rows FROM b GROUP BY 1",
        "band_read_pruned": f"WITH {_cats('b')} SELECT floor((dec + 90)/(0.05::DOUBLE))::BIGINT AS band, count(*) AS n_rows, min(row) AS first_row, max(row) AS last_row FROM b GROUP BY 1 HAVING band BETWEEN 600 AND 602",
        "all_pairs_ab": f"{ab} {pairs} p",
        "all_pairs_ac_override": f"WITH {_cats('ac')}, {_near('p', 'a', 'c', 0.8)} SELECT i AS a_row, j AS c_row, round(sep, 4) AS sep FROM p",
        "self_pairs_b": f"WITH {_cats('b')}, {_dedupe('b', 0.4)} SELECT i AS first_row, j AS second_row, round(sep, 4) AS sep FROM bs",
        "dedupe_b": f"WITH {_cats('b')}, {_dedupe('b', 0.4)} SELECT row, status, kept_row FROM bo",
        "candidate_edges_active": f"{edges} SELECT survey_a, survey_b, row_a, row_b, round(sep, 4) AS sep FROM e",
        "clique_signatures": f"{edges} SELECT node, len(sig)::INTEGER AS n_linked, sig[1] AS lowest, clique AS is_clique FROM sq",
        "degenerate_swapped_order": f"WITH {_active_edges()}, {_policy('m', 'ab', 'mutual_nearest')} SELECT j AS b_row, i AS a_row, round(sep::FLOAT::DOUBLE, 3) AS b_a_sep FROM m",
        "degenerate_anchored_nearest": f"WITH {_active_edges()}, {_policy('m', 'ab', 'anchored_nearest')} SELECT i AS a_row, j AS b_row, round(sep::FLOAT::DOUBLE, 3) AS a_b_sep FROM m",
        "saved_edges_roundtrip": three["mutual_nearest"],
        "entity_refuse": f"{entities} SELECT * FROM ent",
        "entity_split": _resolved(_SPLIT),
        "entity_split_cap3": _resolved(_SPLIT, size_cap=3),
        "entity_sequential": _resolved(_sequential([1, 0, 2])),
        "banded_equals_memory": f"{entities} SELECT * FROM ent",
        "bands_swept": f"{entities} SELECT * FROM ent",
        "crossmatch_entities": f"{entities} SELECT * FROM ent",
        "entity_refuse_drop": f"{entities} SELECT * FROM ent WHERE disputed_reason IS NULL",
        "entity_refuse_selection": f"{entities} SELECT * FROM ent WHERE (a_row IS NOT NULL)::INT + (b_row IS NOT NULL)::INT + (c_row IS NOT NULL)::INT >= 2 AND a_row IS NOT NULL",
        "entity_sorted_index": f"{entities} SELECT row_number() OVER (ORDER BY CASE WHEN a_row IS NOT NULL THEN 0 WHEN b_row IS NOT NULL THEN 1 ELSE 2 END, coalesce(a_row, b_row, c_row)) - 1 AS ordinal, * FROM ent",
        "components_census": f"{edges}, {reach}, lab AS (SELECT c.node, c.component, sq.clique FROM comp c JOIN sq USING (node) UNION ALL SELECT node, node, TRUE FROM act WHERE node NOT IN (SELECT node FROM sg)), "
        "per AS (SELECT component, count(*) AS n, bit_or(1::BIGINT << (node >> 48)::INT) AS bits, bool_and(clique) AS clique FROM lab GROUP BY component) "
        "SELECT least(n, 6) AS size, bits AS survey_bits, clique AS is_clique, count(*) AS n_components, sum(n)::BIGINT AS n_rows FROM per GROUP BY ALL",
        "audit_pairs": f"{edges}, ra AS (SELECT survey_a, survey_b, count(*) AS matched_a, count(*) FILTER (n > 1) AS multi_a FROM (SELECT survey_a, survey_b, row_a, count(*) AS n FROM e GROUP BY ALL) GROUP BY ALL), "
        "rb AS (SELECT survey_a, survey_b, count(*) AS matched_b, count(*) FILTER (n > 1) AS multi_b FROM (SELECT survey_a, survey_b, row_b, count(*) AS n FROM e GROUP BY ALL) GROUP BY ALL) "
        "SELECT survey_a, survey_b, n_edges, matched_a, multi_a, matched_b, multi_b FROM (SELECT survey_a, survey_b, count(*) AS n_edges FROM e GROUP BY ALL) JOIN ra USING (survey_a, survey_b) JOIN rb USING (survey_a, survey_b)",
        "audit_surveys": f"{edges}, per AS ("
        + " UNION ALL ".join(
            f"SELECT '{n}' AS survey, (SELECT count(*) FROM {n}) AS n_rows, "
            + (
                "0::BIGINT AS n_dropped, 0::BIGINT AS n_disputed, 0::BIGINT AS n_duplicate_groups, 0::BIGINT AS largest_duplicate_group"
                if n == "a"
                else f"(SELECT count(*) FROM {n}o WHERE status = 'dropped') AS n_dropped, (SELECT count(*) FROM {n}o WHERE status = 'disputed') AS n_disputed, "
                f"(SELECT count(DISTINCT kept_row) FROM {n}o) AS n_duplicate_groups, (SELECT max(k) + 1 FROM (SELECT count(*) AS k FROM {n}o WHERE kept_row IS NOT NULL GROUP BY kept_row)) AS largest_duplicate_group"
            )
            for n in "abc"
        )
        + ") SELECT * FROM per",
        "separation_percentiles": f"{edges} SELECT survey_a, survey_b, "
        + ", ".join(f"round(quantile_cont(sep, {p / 100}), 4) AS p{p}" for p in (5, 25, 50, 75, 95))
        + " FROM e GROUP BY ALL",
        "rows_to_ids_ab": f"WITH {_entities('ab')} SELECT a.key AS a_id, b.key AS b_id, disputed_reason FROM ent LEFT JOIN a ON a.row = a_row LEFT JOIN b ON b.row = b_row",
        "ids_to_rows_ab": f"WITH {_active_edges('ab')}, {_policy('m', 'ab', 'mutual_nearest')} SELECT i AS a_row, j AS b_row, round(sep::FLOAT::DOUBLE, 3) AS a_b_sep FROM m",
        "hub_uid_spatial": f"WITH {_cats('ab')}, {_near('p', 'a', 'b', 1.0)}, {_policy('m', 'p', 'mutual_nearest')}, k AS (SELECT row_number() OVER (ORDER BY uid) - 1 AS row, uid FROM (SELECT DISTINCT l_orderkey AS uid FROM lineitem)) "
        "SELECT row_number() OVER (ORDER BY a.row) - 1 AS entity_id, a.row AS a_row, k.row AS k_row, m.j AS b_row FROM a JOIN k ON k.uid = a.key JOIN m ON m.i = a.row",
        "hub_two_spatial": f"WITH {_cats('abc')}, {_near('p', 'a', 'b', 1.0)}, {_near('q', 'a', 'c', 0.8)}, {_policy('m', 'p', 'anchored_nearest')}, {_policy('n', 'q', 'mutual_nearest')} "
        "SELECT row_number() OVER (ORDER BY m.i) - 1 AS entity_id, m.i AS a_row, m.j AS b_row, n.j AS c_row FROM m JOIN n ON m.i = n.i",
    }
    out |= {f"all_pairs_k{k}": f"{ab} {pairs} (SELECT *, row_number() OVER (PARTITION BY i ORDER BY sep, j) AS k FROM p) WHERE k <= {k}" for k in (1, 2)}
    out |= {f"policy_{p}": f"{ab}, {_policy('m', 'p', p)} {pairs} m" for p in POLICIES}
    out |= {f"degenerate_abc_{p}": sql for p, sql in three.items()}
    out |= {n: _uid_sql(n) for n in UIDS}
    return out
