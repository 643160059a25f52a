"""Builds over more bands than there should be folders."""

import os

import pytest

import catweave as cw
from catweave.sources import storage as st

SETTINGS = {"radius_arcsec": 1.0, "dedupe_radius_arcsec": 0.0}


@pytest.fixture(scope="module")
def spread(spark):
    """Two rows, 0.5 arcseconds apart, in each of 150 bands of 0.01 degrees; one pair crosses a boundary."""
    a = [(i, 10.0, i * 0.01 + 0.005) for i in range(150)] + [(150, 20.0, 0.0999999)]
    b = [(i, 10.0, d + 0.5 / 3600) for i, _, d in a[:150]] + [(150, 20.0, 0.1000001)]
    return {n: spark.createDataFrame(x, "row long, ra double, dec double") for n, x in (("a", a), ("b", b))}


def _build(spark, spread, tmp_path, in_runs):
    layout, path = f"file://{tmp_path}/l", f"file://{tmp_path}/e"
    st.write_band_layout(spark, layout, spread, band_height_deg=0.01)
    if not in_runs:
        st.build_edges_by_band(spark, layout, path, **SETTINGS)
        return path
    bands = st.prepare_band_build(spark, layout, path, **SETTINGS)
    parts = st.runs(bands, 3)
    assert len(bands) == 150 and len(parts) == 3 and sum(parts, []) == bands
    for part in parts[:-1]:
        st.build_bands(spark, path, part)
    with pytest.raises(ValueError, match="50 bands are not built"):
        st.sweep_boundaries(spark, path)
    with pytest.raises(ValueError, match="runs of the list"):
        st.build_bands(spark, path, bands[::2])
    st.build_bands(spark, path, parts[-1])
    st.sweep_boundaries(spark, path)
    return path


@pytest.mark.parametrize("in_runs", [False, True])
def test_many_bands_take_few_folders(spark, spread, tmp_path, in_runs):
    path = _build(spark, spread, tmp_path, in_runs)
    assert not [n for n in os.listdir(f"{tmp_path}/l/a") if "=" in n]
    names = st.segment_names(spark, path)
    assert len(names) <= 2 * st.MOST_SLICES and len([n for n in os.listdir(f"{tmp_path}/e/rows") if "=" in n]) == len(names)
    mode = cw.EntitywiseCrossmatchConfig()
    want = [(i, i, None) for i in range(151)]
    assert sorted(map(tuple, cw.resolve(st.read_edges(spark, path), mode).df.collect())) == want
    parts = [st.read_segments(spark, path, p) for p in st.runs(names, 4)]
    assert sorted(map(tuple, cw.resolve(cw.combine_segments(parts), mode).df.collect())) == want
    with pytest.raises(ValueError, match="no segments"):
        st.read_segments(spark, path, ["nope"])
