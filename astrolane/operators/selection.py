"""Row predicates: sky regions, redshift shells and closed ranges, with the pushable bounds that prune a scan."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import sphere


def in_range(column, low: float | None, high: float | None) -> Column:
    """Closed range, either side open if None.  NaN and null are outside."""
    c = sphere._c(column)
    parts = ([c >= F.lit(low)] if low is not None else []) + ([c <= F.lit(high)] if high is not None else [])
    if not parts:
        return F.lit(True)
    if high is None:  # NaN sorts above every number
        parts.append(~F.isnan(c.cast("double")))
    return F.coalesce(reduce(lambda a, b: a & b, parts), F.lit(False))


@dataclass(frozen=True)
class Cone:
    """Positions within `radius` degrees of (ra, dec)."""

    ra: float
    dec: float
    radius: float

    def column(self, ra="ra", dec="dec", z="z") -> Column:
        """A bounding box that reaches the Parquet reader, and the exact separation."""
        low, high = self.dec - self.radius, self.dec + self.radius
        box = in_range(dec, low - 1e-9, high + 1e-9)
        if low > -90 and high < 90:
            reach = math.degrees(math.asin(min(1.0, math.sin(math.radians(self.radius)) / math.cos(math.radians(self.dec))))) if self.radius < 90 else 180.0
            west, east = self.ra % 360 - reach, self.ra % 360 + reach
            c = sphere._c(ra)
            if reach < 180 and west >= 0 and east < 360:
                box &= in_range(c, west - 1e-9, east + 1e-9) | (c < 0) | (c >= 360)
        return box & F.coalesce(sphere.separation(ra, dec, self.ra, self.dec) <= self.radius, F.lit(False))

    def cells(self, nside: int) -> list[int]:
        return sphere.cone_cells(self.ra, self.dec, self.radius, nside)


@dataclass(frozen=True)
class Shell:
    """Redshifts in the closed range z_min to z_max; a missing redshift is outside."""

    z_min: float
    z_max: float

    def column(self, ra="ra", dec="dec", z="z") -> Column:
        return in_range(z, self.z_min, self.z_max)

    def cells(self, nside: int) -> None:
        return None


@dataclass(frozen=True)
class SkyPatch:
    """A closed box; ra_min > ra_max takes the side across right ascension 0."""

    ra_min: float
    ra_max: float
    dec_min: float
    dec_max: float

    def column(self, ra="ra", dec="dec", z="z") -> Column:
        if self.ra_min <= self.ra_max:
            across = in_range(ra, self.ra_min, self.ra_max)
        else:
            across = in_range(ra, self.ra_min, None) | in_range(ra, None, self.ra_max)
        return across & in_range(dec, self.dec_min, self.dec_max)

    def cells(self, nside: int) -> list[int]:
        return sphere.box_cells(self.ra_min, self.ra_max, self.dec_min, self.dec_max, nside)


def selected(selections, ra="ra", dec="dec", z="z") -> Column:
    """None selects all rows, one selection its rows, a list the rows of all of them."""
    if selections is None:
        return F.lit(True)
    if not isinstance(selections, (list, tuple)):
        selections = [selections]
    return reduce(lambda a, b: a & b, (s.column(ra, dec, z) for s in selections), F.lit(True))


def cells_of(cone: Cone | None, patch: SkyPatch | None, cells: list[int] | None, nside: int, narrow: bool = False) -> list[int] | None:
    """The union of the regions' cells and the explicit ones; narrow=True intersects instead.  None: no pruning."""
    given = [set(x) for x in (cone and cone.cells(nside), patch and patch.cells(nside), cells) if x is not None]
    if not given:
        return None
    return sorted(set.intersection(*given) if narrow else set.union(*given))
