"""Repeated measurements of one object, combined into one row in a single shuffle on its id."""

from __future__ import annotations

import logging
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sphere import finite
from .identity import IdentityIndex
from .weights import Weight, default_weight

log = logging.getLogger(__name__)
STRATEGIES = ("best_only", "ivar_average", "hyperparameter", "unit_mean")


def usable(value: str, variance: str) -> Column:
    return finite(F.col(variance)) & (F.col(variance).cast("double") > 0) & finite(F.col(value))


def _survey_list() -> Column:
    return F.array_join(F.array_sort(F.collect_set("survey")), ",")


def combine(rows: DataFrame, value: str = "value", variance: str = "variance", survey: str = "survey", uid: str = "uid", strategy: str = "ivar_average", alpha: Mapping[str, float] | None = None, weight: Column | None = None, tie: str | None = None) -> DataFrame:
    """uid, value, variance, weight, n_surveys, surveys.

    best_only: the row of least variance (ties: survey, then `tie`).  ivar_average: weights 1 / variance, or `weight`.
    hyperparameter: each survey's weights times alpha[survey] (1 if absent).  unit_mean: weights over their survey's
    mean, no variance.  Rows without a finite value and a positive finite variance are left out, and so are objects
    whose weights add up to nothing.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; there are {STRATEGIES}")
    for c in (value, variance, survey, uid):
        if c not in rows.columns:
            raise KeyError(c)
    w = 1.0 / F.col(variance).cast("double") if weight is None else weight
    used = rows.where(usable(value, variance)).select(F.col(uid).alias("uid"), F.col(survey).alias("survey"), F.col(value).cast("double").alias("v"), F.col(variance).cast("double").alias("var"), w.alias("w"), (F.col(tie) if tie else F.lit(0)).alias("tie"))
    if strategy == "best_only":
        best = F.min(F.struct("var", "survey", "tie", "v")).alias("best")
        return used.groupBy("uid").agg(best, F.countDistinct("survey").alias("n_surveys"), _survey_list().alias("surveys")).select("uid", F.col("best.v").alias("value"), F.col("best.var").alias("variance"), (1.0 / F.col("best.var")).alias("weight"), "n_surveys", "surveys")
    if strategy == "hyperparameter" and alpha:
        factor = F.create_map(*[F.lit(x) for k, v in sorted(alpha.items()) for x in (k, float(v))])
        used = used.withColumn("w", F.col("w") * F.coalesce(factor[F.col("survey")], F.lit(1.0)))
    if strategy == "unit_mean":
        # a few rows of means joined back: a window over a survey would gather all of its rows in one task
        means = used.groupBy("survey").agg(F.avg("w").alias("mean"))
        used = used.join(means, "survey").withColumn("w", F.when(F.col("mean") != 0, F.col("w") / F.col("mean")))
    total = F.sum("w")
    out = used.groupBy("uid").agg(total.alias("weight"), F.sum(F.col("w") * F.col("v")).alias("s"), F.countDistinct("survey").alias("n_surveys"), _survey_list().alias("surveys"))
    if strategy == "unit_mean":
        log.warning("unit_mean rescales weights by survey, so its variances mean nothing and are left out")
    spread = F.lit(None).cast("double") if strategy == "unit_mean" else 1.0 / F.col("weight")
    return out.where("weight > 0").select("uid", (F.col("s") / F.col("weight")).alias("value"), spread.alias("variance"), "weight", "n_surveys", "surveys")


@dataclass
class WeightedCatalog:
    """Catalogs of several surveys with weights, and the table (uid, dataset, row_index) that matches their rows.

    Frames have the stable row number in `row_index`.  A survey without weights has weight one.
    """

    frames: Mapping[str, DataFrame]
    match: DataFrame | None = None
    weights: dict[str, list[Weight]] = field(default_factory=dict)

    def add_weight(self, survey: str, weight: Weight) -> "WeightedCatalog":
        if survey not in self.frames:
            raise KeyError(survey)
        self.weights.setdefault(survey, []).append(weight)
        return self

    @classmethod
    def from_identity(cls, index: IdentityIndex, open_dataset: Callable[[str], DataFrame] | Mapping[str, DataFrame], datasets: list[str] | None = None) -> "WeightedCatalog":
        """The datasets of an identity index (row_index and columns each), matched by it."""
        names = index.datasets() if datasets is None else datasets
        frames = {n: open_dataset[n] if isinstance(open_dataset, Mapping) else open_dataset(n) for n in names}
        return cls(frames, index.rows.where(F.col("dataset").isin(sorted(names))).select("uid", "dataset", "row_index"))

    def fill_defaults(self, types: Mapping[str, tuple[str, str]], skip_unknown: bool = False) -> "WeightedCatalog":
        """types: survey -> (survey type, redshift type).  Surveys that have weights keep them.

        skip_unknown: surveys of a kind without a default stay as they are, in place of an error.
        """
        for survey, (kind, z_type) in types.items():
            if not self.weights.get(survey):
                try:
                    weight = default_weight(kind, z_type)
                except (KeyError, ValueError):
                    if skip_unknown:
                        continue
                    raise
                self.add_weight(survey, weight)
        return self

    def fill_from_database(self, database, z_type: str, skip_unknown: bool = False) -> "WeightedCatalog":
        """Defaults by the survey types that a database's manifests name."""
        return self.fill_defaults({n: (database.entry(n).manifest.survey_type, z_type) for n in self.frames}, skip_unknown)

    def total_weight(self, survey: str) -> Column:
        out = F.lit(1.0)
        for w in self.weights.get(survey, []):
            out = out * w.on(self.frames[survey])
        return out

    def _matched(self) -> DataFrame:
        if self.match is None:
            raise RuntimeError("the catalogs are not matched yet")
        return self.match

    def concurrences(self, value: str, variance: str) -> DataFrame:
        """uid, survey, row_index, value, variance, weight: every matched row."""
        parts = None
        for survey in sorted(self.frames):
            frame = self.frames[survey]
            own = self._matched().where(F.col("dataset") == survey).select("uid", "row_index")
            rows = frame.select("row_index", F.col(value).cast("double").alias("value"), F.col(variance).cast("double").alias("variance"), self.total_weight(survey).alias("weight"))
            part = own.join(rows, "row_index").select("uid", F.lit(survey).alias("survey"), "row_index", "value", "variance", "weight")
            parts = part if parts is None else parts.unionByName(part)
        return parts

    def combine(self, value: str, variance: str, strategy: str = "ivar_average", alpha: Mapping[str, float] | None = None, use_weights: bool = False) -> DataFrame:
        """Weights come from the variance alone unless use_weights is set."""
        return combine(self.concurrences(value, variance), strategy=strategy, alpha=alpha, weight=F.col("weight") if use_weights else None, tie="row_index")

    def n_universal(self) -> int:
        return self._matched().select("uid").distinct().count()

    def n_multi_survey(self) -> int:
        return self._matched().groupBy("uid").agg(F.countDistinct("dataset").alias("n")).where("n > 1").count()

    def __repr__(self) -> str:
        return f"WeightedCatalog({', '.join(f'{s}: {len(self.weights.get(s, []))} weights' for s in sorted(self.frames))})"
