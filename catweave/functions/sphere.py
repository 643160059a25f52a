"""Functions on the sphere: unit vectors, chords, declination bands."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

ARCSEC = math.pi / 648000.0


def arcsec_to_chord(radius_arcsec: float) -> float:
    """Length of the chord that spans an angle."""
    return 2.0 * math.sin(radius_arcsec * ARCSEC / 2.0)


def chord_to_arcsec(chord: Column) -> Column:
    """Angle spanned by a chord of the unit sphere."""
    return F.asin(F.least(F.lit(1.0), F.greatest(F.lit(0.0), chord / 2.0))) * 2.0 / ARCSEC


def unit_vector(ra: Column, dec: Column) -> tuple[Column, Column, Column]:
    """Cartesian components of a direction in degrees."""
    a, d = F.radians(ra), F.radians(dec)
    return F.cos(d) * F.cos(a), F.cos(d) * F.sin(a), F.sin(d)


def direction(x: Column, y: Column, z: Column) -> tuple[Column, Column]:
    """Right ascension in [0, 360) and declination of a unit vector, in degrees."""
    return F.pmod(F.degrees(F.atan2(y, x)), F.lit(360.0)), F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), z))))


def band_of(dec: Column, height_deg: float) -> Column:
    """Number of the declination band, from the south pole."""
    return F.floor((dec + 90.0) / height_deg).cast("long")


def check_match_radius(radius_arcsec: float, what: str = "matching radius") -> None:
    if not (math.isfinite(radius_arcsec) and radius_arcsec > 0):
        raise ValueError(f"{what} must be finite and greater than 0, not {radius_arcsec}")
