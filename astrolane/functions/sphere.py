"""Angles on the sphere as Column expressions, HEALPix cells, and covers of regions by cells.

All angles are degrees unless a name says otherwise.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

ARCSEC = 3600.0


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))


def finite(c: Column) -> Column:
    """True for a number that is neither null, NaN nor infinite; never null."""
    c = c.cast("double")
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def separation(ra1, dec1, ra2, dec2) -> Column:
    """Great-circle separation by the Vincenty formula, accurate at all distances."""
    d1, d2 = F.radians(_c(dec1)), F.radians(_c(dec2))
    dl = F.radians(_c(ra2) - _c(ra1))
    a = F.cos(d2) * F.sin(dl)
    b = F.cos(d1) * F.sin(d2) - F.sin(d1) * F.cos(d2) * F.cos(dl)
    return F.degrees(F.atan2(F.sqrt(a * a + b * b), F.sin(d1) * F.sin(d2) + F.cos(d1) * F.cos(d2) * F.cos(dl)))


def haversine(ra1, dec1, ra2, dec2) -> Column:
    """Great-circle separation by the haversine formula: cheap, and stable for arcseconds."""
    d1, d2 = F.radians(_c(dec1)), F.radians(_c(dec2))
    a, b = F.sin((d2 - d1) / 2), F.sin(F.radians(_c(ra2) - _c(ra1)) / 2)
    return F.degrees(2 * F.asin(F.least(F.lit(1.0), F.sqrt(a * a + F.cos(d1) * F.cos(d2) * b * b))))


def unit_vector(ra, dec) -> tuple[Column, Column, Column]:
    a, d = F.radians(_c(ra)), F.radians(_c(dec))
    return F.cos(d) * F.cos(a), F.cos(d) * F.sin(a), F.sin(d)


def chord_of_arcsec(arcsec: float) -> float:
    return 2.0 * math.sin(math.radians(arcsec / ARCSEC) / 2)


def arcsec_of_chord(chord) -> Column:
    return F.degrees(2 * F.asin(F.least(F.lit(1.0), F.greatest(F.lit(0.0), _c(chord) / 2)))) * ARCSEC


def healpix_nest(ra, dec, nside: int) -> Column:
    """NESTED pixel (long) of a position; null where a coordinate is not finite.  Gorski et al. 2005, ApJ 622, 759."""
    order = nside.bit_length() - 1
    if nside != 1 << order:
        raise ValueError("nside must be a power of two")
    ra, dec = _c(ra).cast("double"), _c(dec).cast("double")
    n, z = float(nside), F.sin(F.radians(dec))
    t = F.pmod(ra, F.lit(360.0)) / 90.0
    whole = lambda c: F.floor(c).cast("long")
    up, down = whole(n * (0.5 + t) - 0.75 * n * z), whole(n * (0.5 + t) + 0.75 * n * z)
    fu, fd = whole(up / nside), whole(down / nside)
    face = F.when(fu == fd, F.pmod(fu, F.lit(4)) + 4).when(fu < fd, F.pmod(fu, F.lit(4))).otherwise(F.pmod(fd, F.lit(4)) + 8)
    q = F.least(F.lit(3), whole(t))
    p, s = t - q, n * F.sqrt(3 * (1 - F.abs(z)))
    pu, pd = F.least(F.lit(nside - 1), whole(p * s)), F.least(F.lit(nside - 1), whole((1 - p) * s))
    belt, north = F.abs(z) <= 2.0 / 3.0, z > 0
    face = F.when(belt, face).when(north, q).otherwise(q + 8)
    x = F.when(belt, F.pmod(down, F.lit(nside))).when(north, nside - 1 - pd).otherwise(pu)
    y = F.when(belt, nside - 1 - F.pmod(up, F.lit(nside))).when(north, nside - 1 - pu).otherwise(pd)
    pixel = face.cast("long") * nside * nside
    for bit in range(order):
        pixel = pixel + F.shiftleft(F.shiftright(x, bit).bitwiseAND(F.lit(1)).cast("long"), 2 * bit) + F.shiftleft(F.shiftright(y, bit).bitwiseAND(F.lit(1)).cast("long"), 2 * bit + 1)
    return F.when(finite(ra) & finite(dec), pixel)


@lru_cache(maxsize=8)
def cell_centres(nside: int) -> np.ndarray:
    """Unit vectors of all 12 nside**2 NESTED pixel centres."""
    pix = np.arange(12 * nside * nside)
    face, rest = pix // (nside * nside), pix % (nside * nside)
    x, y = np.zeros_like(pix), np.zeros_like(pix)
    for bit in range(nside.bit_length() - 1):
        x |= (rest >> (2 * bit) & 1) << bit
        y |= (rest >> (2 * bit + 1) & 1) << bit
    ring = (face // 4 + 2) * nside - x - y - 1
    first = np.where(face // 4 == 1, 2 * (face % 4), 2 * (face % 4) + 1)  # the face's place in quarter turns / 2
    cap = np.minimum(np.minimum(ring, 4 * nside - ring), nside)
    z = np.where(ring < nside, 1 - cap**2 / (3.0 * nside**2), np.where(ring > 3 * nside, cap**2 / (3.0 * nside**2) - 1, (2 * nside - ring) * 2.0 / (3 * nside)))
    phi = (first * cap + x - y) * (np.pi / 4) / cap
    r = np.sqrt(1 - z * z)
    return np.stack([r * np.cos(phi), r * np.sin(phi), z], axis=1)


def cell_radius(nside: int) -> float:
    """More than the distance of any point of a cell from the cell's centre."""
    return 2.5 * 32 / nside


def cone_cells(ra: float, dec: float, radius: float, nside: int) -> list[int]:
    """A superset of the cells that a cone meets: exact predicates follow, so more cells never change a result."""
    a, d = math.radians(ra), math.radians(dec)
    centre = np.array([math.cos(d) * math.cos(a), math.cos(d) * math.sin(a), math.sin(d)])
    reach = math.radians(min(180.0, radius + cell_radius(nside)))
    return np.flatnonzero(cell_centres(nside) @ centre >= math.cos(reach) - 1e-12).tolist()


def box_cells(ra_min: float, ra_max: float, dec_min: float, dec_max: float, nside: int) -> list[int]:
    """A superset of the cells that a box of right ascension and declination meets; ra_min > ra_max crosses 0."""
    v, pad = cell_centres(nside), cell_radius(nside)
    dec = np.degrees(np.arcsin(np.clip(v[:, 2], -1, 1)))
    near = (dec >= dec_min - pad) & (dec <= dec_max + pad)
    steep = min(90.0, max(abs(dec_min), abs(dec_max)) + 2 * pad)
    width = (ra_max - ra_min) % 360.0 if ra_max - ra_min < 360.0 else 360.0
    wide = pad / max(math.cos(math.radians(steep)), 1e-6)
    if steep < 89.0 and width + 2 * wide < 360.0:
        ra = np.degrees(np.arctan2(v[:, 1], v[:, 0]))
        near &= (ra - (ra_min - wide)) % 360.0 <= width + 2 * wide
    return np.flatnonzero(near).tolist()
