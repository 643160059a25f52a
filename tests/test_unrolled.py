"""Large keys take the strip of the catalogues over the poles and on to where it began."""

from pathlib import Path

import pandas as pd
import pytest
from compare import TABLES, expected, rows

import catweave as cw
from catweave.plans import queries as q
from catweave.sources.storage import write_band_layout

SF = Path("/root/testdata/sf0.001")
#: A key this much higher lies a turn further on, less than two arcseconds away on the sphere.
TURN = 7375574
QUERIES = [
    "band_read_pruned",
    "all_pairs_ab",
    "all_pairs_k1",
    "all_pairs_k2",
    "audit_pairs",
    "candidate_edges_active",
    "degenerate_abc_mutual_unique",
    "policy_anchored_unique",
    "policy_mutual_unique",
    "clique_signatures",
    "degenerate_anchored_nearest",
    "crossmatch_entities",
    "entity_refuse_drop",
    "hub_two_spatial",
    "entity_refuse",
    "entity_refuse_selection",
]


@pytest.fixture(scope="module")
def wound(tmp_path_factory):
    d = tmp_path_factory.mktemp("wound")
    for t in set(TABLES) - {"orders", "lineitem"}:
        (d / f"{t}.parquet").symlink_to(SF / f"{t}.parquet")
    keys = [k + t for k in range(1, 13) for t in (0, TURN)]
    pd.DataFrame({"o_orderkey": keys}).to_parquet(d / "orders.parquet")
    # B moves rows of the second turn towards the first; some orders have no such line.
    lines = [(k, 2758 if n == 1 else 1056 if k > TURN else 1700, n) for k in keys for n in (1, 2) if (k + n) % 5]
    lines = pd.DataFrame(lines, columns=["l_orderkey", "l_partkey", "l_linenumber"])
    more = {"l_suppkey": 1, "l_shipdate": pd.Timestamp("2020-01-01"), "l_quantity": 1.0, "l_extendedprice": 1.0, "l_discount": 0.0, "l_tax": 0.0}
    lines.assign(**more).to_parquet(d / "lineitem.parquet")
    return str(d)


@pytest.mark.parametrize("name", QUERIES)
def test_turns_are_apart(spark, wound, name):
    df = q.queries()[name](spark, wound)
    columns, want = expected(q.oracle_sql()[name], wound)
    assert sorted(df.columns) == columns and want
    norm = lambda xs: [x.replace(".0,", ",").replace(".0)", ")") for x in xs]
    assert norm(rows(df)) == norm(want)


def test_only_unrolled_declinations_pass_the_poles(spark, tmp_path):
    far = {"a": spark.createDataFrame([(0, 10.0, 300.0), (1, 10.0, -60.0)], "row long, ra double, dec double")}
    with pytest.raises(ValueError, match="within -90 and 90"):
        write_band_layout(spark, f"file://{tmp_path}/l", far, band_height_deg=0.1)
    write_band_layout(spark, f"file://{tmp_path}/l", far, band_height_deg=0.1, unrolled=True)
    settings = {"radius_arcsec": 1.0, "dedupe_radius_arcsec": 0.5, "mode": cw.EntitywiseCrossmatchConfig()}
    with pytest.raises(ValueError, match="within -90 and 90"):
        cw.crossmatch(spark, far, **settings)
    assert cw.crossmatch(spark, far, unrolled=True, **settings).df.count() == 2
