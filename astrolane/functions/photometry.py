"""Fluxes, magnitudes, distances and vector columns as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .sphere import _c

HUBBLE = 67.36
LIGHT_SPEED = 299_792.458


def flux_to_magnitude(flux) -> Column:
    """22.5 - 2.5 log10(flux in nanomaggies) as float; null unless the flux is positive."""
    f = _c(flux).cast("double")
    return F.when((f > 0) & ~F.isnan(f), 22.5 - 2.5 * F.log10(F.greatest(f, F.lit(1e-30)))).cast("float")


def element(vector, i: int) -> Column:
    """The i-th component, from 0; null beyond the end."""
    return F.get(_c(vector), F.lit(i))


def bands(vector, prefix: str, names: str = "ugriz") -> list[Column]:
    return [element(vector, i).alias(f"{prefix}_{band}") for i, band in enumerate(names)]


def count_positive(vector) -> Column:
    return F.size(F.filter(_c(vector), lambda x: (x > 0) & ~F.isnan(x))).cast("byte")


def distance_modulus(distance_mpc) -> Column:
    d = _c(distance_mpc)
    return F.when(d > 0, 5 * F.log10(d) + 25)


def hubble_distance(z) -> Column:
    """Distance in Mpc from a small redshift, cz / H0."""
    return _c(z) * (LIGHT_SPEED / HUBBLE)


def velocity_error(modulus_error, z) -> Column:
    """ln(10) / 5 * modulus error * cz."""
    return F.log(F.lit(10.0)) / 5 * _c(modulus_error) * _c(z) * LIGHT_SPEED


def sampled_redshift(uniform, z_min: float, z_max: float) -> Column:
    """Inverse distribution function of a density proportional to z squared."""
    low, high = z_min**3, z_max**3
    return F.pow(low + _c(uniform) * (high - low), F.lit(1.0 / 3.0))


def interpolated(x, knots: list[float], values: list[float]) -> Column:
    """Linear interpolation in a bounded table, constant beyond its ends."""
    c = _c(x)
    out = F.lit(float(values[-1]))
    for a, b, p, q in reversed(list(zip(knots, knots[1:], values, values[1:], strict=False))):
        out = F.when(c < b, p + (c - a) * ((q - p) / (b - a))).otherwise(out)
    return F.when(c <= knots[0], F.lit(float(values[0]))).otherwise(out)
