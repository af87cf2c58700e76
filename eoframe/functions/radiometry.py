"""Digital-number scaling and spectral indices as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Landsat Collection 2 Level-2 scale factors and valid ranges.
SR_GAIN, SR_OFFSET = 2.75e-5, -0.2          # surface reflectance
ST_GAIN, ST_OFFSET = 3.41802e-3, 149.0      # surface temperature, Kelvin
KELVIN_TO_CELSIUS = -273.15
SR_VALID_RANGE = (7273, 43636)
ST_VALID_RANGE = (293, 61440)
S2_REFLECTANCE_DIVISOR = 10000.0
S2_UNSCALED_BANDS = ("scl", "qa", "mask", "water_vapour", "aerosol_optical_thickness")


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rescale(c, gain: float, offset: float = 0.0) -> Column:
    """``c * gain + offset`` in double precision."""
    return _c(c).cast("double") * F.lit(gain) + F.lit(offset)


def to_reflectance(c) -> Column:
    return rescale(c, SR_GAIN, SR_OFFSET)


def s2_reflectance(band: str) -> Column:
    """a Sentinel-2 band scaled to 0-1; bands that hold no reflectance stay as they are."""
    c = F.col(band)
    return c if band in S2_UNSCALED_BANDS else c.cast("double") / F.lit(S2_REFLECTANCE_DIVISOR)


def to_kelvin(c) -> Column:
    """surface-temperature DN -> Kelvin."""
    return rescale(c, ST_GAIN, ST_OFFSET)


def to_celsius(c) -> Column:
    """surface-temperature DN -> degrees Celsius (Kelvin first, then shift)."""
    return to_kelvin(c) + F.lit(KELVIN_TO_CELSIUS)


def normalized_difference(a, b) -> Column:
    """(a - b) / (a + b); null where the denominator is 0 or an input is null."""
    a, b = _c(a).cast("double"), _c(b).cast("double")
    return F.try_divide(a - b, a + b)


def in_range(c, lo, hi) -> Column:
    """Keep ``c`` where lo <= c <= hi, else null."""
    c = _c(c)
    return F.when(c.between(lo, hi), c)
