"""An extension: new Parquet drops of a catalog matched to an existing one as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.match import MatchRules, spherical_join, stacked


def match_drops(spark: SparkSession, drops: str, schema, catalog: DataFrame, rules: MatchRules, out: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch's pairs with the catalog (row_index of the drop and of the catalog, separation) are added to `out`.

    Folders are named by the batch, so a batch that is repeated after a failure replaces its own output.
    """

    def run(batch: DataFrame, number: int) -> None:
        # the drop is the side that is copied to neighbouring cells; the catalog is only read
        kept, drop = stacked({"catalog": catalog}), stacked({"drop": batch})
        pairs = spherical_join(kept, drop, rules.sky_tol_arcsec, rules.accepts(F.col("l_z_type"), F.col("r_z_type"), F.col("l_z"), F.col("r_z")))
        pairs.selectExpr("r_row_index AS drop_row", "l_row_index AS catalog_row", "sep_arcsec").write.mode("overwrite").parquet(f"{out}/batch={number}")

    return spark.readStream.schema(schema).parquet(drops).writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
