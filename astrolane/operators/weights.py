"""Row weights as Columns: finite, never negative."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Weight:
    name = "weight"
    needs: tuple[str, ...] = ()

    def column(self) -> Column:
        raise NotImplementedError

    def on(self, df: DataFrame, checked: bool = False) -> Column:
        """The weight over df's columns; KeyError for a missing one.  checked=True fails the job on a bad value."""
        for c in self.needs:
            if c not in df.columns:
                raise KeyError(c)
        w = self.column()
        if not checked:
            return w
        good = w.isNotNull() & ~F.isnan(w) & (w >= 0) & (w < float("inf"))
        return F.when(good, w).otherwise(F.raise_error(F.lit(f"{self.name} gave a weight that is negative or not finite")).cast("double"))

    def __mul__(self, other: "Weight") -> "ProductWeight":
        return ProductWeight((self, other))


@dataclass(frozen=True)
class ConstantWeight(Weight):
    value: float = 1.0
    name = "constant"

    def __post_init__(self):
        if not self.value >= 0:
            raise ValueError("a constant weight must not be negative")

    def column(self):
        return F.lit(float(self.value))


@dataclass(frozen=True)
class ColumnWeight(Weight):
    source: str
    name = "column"

    @property
    def needs(self):
        return (self.source,)

    def column(self):
        return F.col(self.source).cast("double")


@dataclass(frozen=True)
class QualityMaskWeight(Weight):
    """1 where `source op threshold` holds, else 0.  A missing value fails every comparison but !=."""

    source: str
    op: str
    threshold: float
    name = "quality_mask"

    def __post_init__(self):
        if self.op not in ("==", "!=", ">", ">=", "<", "<="):
            raise ValueError(f"unknown comparison {self.op!r}")

    @property
    def needs(self):
        return (self.source,)

    def column(self):
        c, t = F.col(self.source).cast("double"), F.lit(float(self.threshold))
        missing = c.isNull() | F.isnan(c)
        test = {"==": c == t, "!=": c != t, ">": c > t, ">=": c >= t, "<": c < t, "<=": c <= t}[self.op]
        return F.when(missing, 1.0 if self.op == "!=" else 0.0).when(test, 1.0).otherwise(0.0)


@dataclass(frozen=True)
class InverseVarianceWeight(Weight):
    """1 / (error**2 + floor**2); 0 where that is not a positive number."""

    source: str
    floor: float = 0.0
    name = "ivar"

    @property
    def needs(self):
        return (self.source,)

    def column(self):
        e = F.col(self.source).cast("double")
        variance = e * e + float(self.floor) ** 2
        return F.when((variance > 0) & ~F.isnan(variance), 1.0 / variance).otherwise(0.0)


@dataclass(frozen=True)
class FKPWeight(Weight):
    """1 / (1 + density(z) P0); density maps a Column to a Column."""

    density: Callable[[Column], Column]
    p0: float
    z_column: str = "z"
    name = "fkp"

    @property
    def needs(self):
        return (self.z_column,)

    def column(self):
        return 1.0 / (1.0 + self.density(F.col(self.z_column).cast("double")) * float(self.p0))


@dataclass(frozen=True)
class MedianRatioWeight(Weight):
    """The column over its median (a number found beforehand), e.g. signal to noise."""

    source: str
    median: float
    name = "median_ratio"

    @property
    def needs(self):
        return (self.source,)

    def column(self):
        return F.greatest(F.lit(0.0), F.coalesce(F.nanvl(F.col(self.source).cast("double"), F.lit(0.0)), F.lit(0.0))) / float(self.median)


@dataclass(frozen=True)
class ConditionWeight(Weight):
    """One of two constants, by a predicate given as SQL or Column, e.g. a penalty for absorption systems."""

    condition: str
    when_true: float
    when_false: float = 1.0
    name = "condition"

    def column(self):
        return F.when(F.expr(self.condition), float(self.when_true)).otherwise(float(self.when_false))


@dataclass(frozen=True)
class InverseCompletenessWeight(Weight):
    """1 / completeness, completeness held between `least` and 1."""

    source: str
    least: float = 0.1
    name = "inverse_completeness"

    @property
    def needs(self):
        return (self.source,)

    def column(self):
        c = F.col(self.source).cast("double")
        return 1.0 / F.greatest(F.lit(float(self.least)), F.least(F.lit(1.0), F.coalesce(F.nanvl(c, F.lit(1.0)), F.lit(1.0))))


@dataclass(frozen=True)
class ProductWeight(Weight):
    parts: tuple[Weight, ...]
    name = "product"

    @property
    def needs(self):
        return tuple(c for p in self.parts for c in p.needs)

    def column(self):
        return reduce(lambda a, b: a * b, (p.column() for p in self.parts), F.lit(1.0))


#: The error column that a catalog's default weight uses, by survey type and redshift type.
DEFAULT_ERRORS = {
    ("spectroscopic", "spec"): "z_spec_err",
    ("photometric", "phot"): "z_phot_err",
    ("peculiar_velocity", "pec"): "velocity_error",
    ("peculiar_velocity", "pv"): "v_pec_err",
}


def default_weight(survey_type: str, z_type: str) -> Weight:
    try:
        return InverseVarianceWeight(DEFAULT_ERRORS[survey_type, z_type])
    except KeyError:
        raise KeyError(f"no default weight for {(survey_type, z_type)}; there are {sorted(DEFAULT_ERRORS)}") from None
