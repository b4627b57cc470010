"""A survey taken in from its raw file: dataset, identities, default weights.

    python -m astrolane.plans.onboard SURVEY ROOT [RAW_FILE]
"""

from __future__ import annotations

import logging
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.combine import WeightedCatalog
from ..operators.match import MatchRules
from ..sources import loaders
from ..sources.database import Database, convert

log = logging.getLogger(__name__)


def onboard(spark: SparkSession, survey: str, root: str | Path, raw_path: str | None = None, z_type: str = "spec", kind: str = "spectroscopic", sky_tol_arcsec: float = 0.5) -> DataFrame:
    """Convert, index by position, and give default weights: survey, n_rows, mean_weight."""
    target = Path(root) / loaders.survey_config(survey).subpath
    convert(spark, survey, target, raw_path, overwrite=True)
    db = Database(spark, root)
    name = next(n for n in db if db.entry(n).path == target)
    index = db.build_identity([name], MatchRules(sky_tol_arcsec))
    catalog = WeightedCatalog.from_identity(index, db._attributes).fill_defaults({name: (kind, z_type)})
    return catalog.frames[name].agg(F.count(F.lit(1)).alias("n_rows"), F.avg(catalog.total_weight(name)).alias("mean_weight")).select(F.lit(name).alias("survey"), "n_rows", "mean_weight")


if __name__ == "__main__":
    logging.basicConfig(level=logging.INFO)
    log.info("%s", onboard(SparkSession.builder.getOrCreate(), *sys.argv[1:4]).first())
