"""Writers: Parquet in spatial cells or row chunks, statistics in one job, the manifest last."""

from __future__ import annotations

import hashlib
import logging
import shutil
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import sphere
from ..plans.staging import discard, staged
from .manifest import DataFile, Manifest, write_manifest
from .schema import CHUNK_ROWS, Geometry, check_contract
from .validity import Temporal, Validity, now_utc

ROW_INDEX = "_original_row_index"
log = logging.getLogger(__name__)
ROWS_PER_CELL = 100_000


def cell_nside(n_rows: int, most: int = 32) -> int:
    """The finest partitioning, up to nside 32, that leaves about ROWS_PER_CELL rows in a cell of a full sky."""
    nside = 1
    while nside < most and n_rows / (12 * (2 * nside) ** 2) >= ROWS_PER_CELL:
        nside *= 2
    return nside


def numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """Row numbers from the data alone: ranks in a total order of the given columns."""
    from ..operators.match import dense_ids

    return dense_ids(df, order, ROW_INDEX)


def numbered_csv(spark: SparkSession, path: str, **options) -> DataFrame:
    """CSV files with the number of each data row in file order: ranks inside each split, and the rows of those before."""
    lines = spark.read.options(header=True, inferSchema=True, **options).csv(path)
    placed = lines.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__split"), F.monotonically_increasing_id().alias("__at"))
    sizes = placed.groupBy("__file", "__split").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("__file", "__split").rowsBetween(Window.unboundedPreceding, -1)  # one row per split
    bases = sizes.select("__file", "__split", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__base"))
    inside = Window.partitionBy("__file", "__split").orderBy("__at")
    ranked = placed.withColumn("__rank", F.row_number().over(inside) - 1).join(F.broadcast(bases), ["__file", "__split"])
    return ranked.select(*lines.columns, (F.col("__base") + F.col("__rank")).cast("long").alias(ROW_INDEX))


def prepare(out: str | Path, overwrite: bool) -> Path:
    out = Path(out)
    if out.exists():
        if not overwrite:
            raise FileExistsError(str(out))
        shutil.rmtree(out)
    out.mkdir(parents=True)
    return out


def standard_columns(df: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Adds what a point dataset needs: the row number (before any cut), z_err from the type's error, the nside-32 cell."""
    if ROW_INDEX not in df.columns:
        df = numbered(df, order or df.columns)
    if "z_err" not in df.columns:
        found = [c for c in ("z_spec_err", "z_phot_err") if c in df.columns]
        df = df.withColumn("z_err", F.coalesce(*map(F.col, found)) if found else F.lit(None).cast("float"))
    if "_healpix32" not in df.columns and {"ra", "dec"} <= set(df.columns):
        df = df.withColumn("_healpix32", sphere.healpix_nest("ra", "dec", 32).cast("int"))
    return df


def _statistics(df: DataFrame, time_column: str | None) -> dict[str, Column]:
    out = {}
    for name, column in (("ra", "ra"), ("dec", "dec"), ("z", "z"), ("t", time_column)):
        if column and column in df.columns:
            value = F.when(sphere.finite(F.col(column)), F.col(column).cast("double"))
            out |= {f"{name}_lo": F.min(value), f"{name}_hi": F.max(value)}
    return out


def hashes(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, sha256, size of files, read by the executors a megabyte at a time."""

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                h, size = hashlib.sha256(), 0
                with open(path, "rb") as f:
                    while chunk := f.read(1 << 20):
                        h.update(chunk)
                        size += len(chunk)
                yield pa.RecordBatch.from_pydict({"path": [path], "sha256": [h.hexdigest()], "size": pa.array([size], pa.int64())})

    tasks = max(1, min(len(paths), 4 * spark.sparkContext.defaultParallelism))
    return spark.createDataFrame([(p,) for p in paths], "path string").repartition(tasks).mapInArrow(run, "path string, sha256 string, size long")


def _manifest(spark, out: Path, df: DataFrame, geometry: Geometry, survey_name, survey_type, partitioning, temporal, validity, time_column, originals, kwargs, loader, extra, stats=None) -> Manifest:
    """Statistics of every written file in one job over the files themselves, hashes and sizes in another."""
    files = sorted(p for p in (out / "data").rglob("*.parquet"))
    found, hashed = {}, {}
    if files:
        # the data's row carries its file's name; a partition directory must not turn into a column here
        written = spark.read.option("recursiveFileLookup", "true").parquet(str(out / "data"))
        measures = (stats or _statistics)(written, time_column)
        rows = written.groupBy(F.input_file_name().alias("f")).agg(F.count(F.lit(1)).alias("n"), *[c.alias(k) for k, c in measures.items()]).collect()
        found = {Path(r["f"]).parent.name + "/" + Path(r["f"]).name: r.asDict() for r in rows}
        hashed = {r["path"]: r for r in hashes(spark, [str(p) for p in files]).collect()}
    parts = []
    for p in files:
        r = found.get(f"{p.parent.name}/{p.name}", {"n": 0})
        pairs = {k[:-3]: [v, r[f"{k[:-3]}_hi"]] for k, v in r.items() if k.endswith("_lo")}
        cell = int(p.parent.name.split("=")[1]) if "=" in p.parent.name else None
        parts.append(DataFile(str(p.relative_to(out)), r["n"], cell, pairs, hashed[str(p)]["size"], hashed[str(p)]["sha256"][:16]))
    if temporal is None and time_column and time_column in df.columns and parts:
        ranges = [p.ranges["t"] for p in parts if p.ranges.get("t") and None not in p.ranges["t"]]
        if ranges:
            temporal = Temporal(min(r[0] for r in ranges), max(r[1] for r in ranges), time_column)
    written = now_utc()
    manifest = Manifest(survey_name, survey_type, geometry, tuple(parts), df.schema, partitioning or {}, temporal, validity or Validity(written), tuple(originals), {"loader": loader or {}, "options": kwargs or {}}, extra or {}, written)
    write_manifest(out, manifest)
    return manifest


def write_dataset(df: DataFrame, out: str | Path, survey_name: str, survey_type: str, geometry: Geometry = Geometry.POINT, *, objects: DataFrame | None = None, nside: int | None = None, rows_per_file: int | None = None, compression: str = "zstd", overwrite: bool = False, time_column: str | None = None, temporal: Temporal | None = None, validity: Validity | None = None, original_files: tuple[dict, ...] = (), conversion_kwargs: dict | None = None, loader: dict | None = None, extra: dict | None = None, stats=None) -> Manifest:
    """Write a dataset and its manifest.

    Points go to one directory per HEALPix cell, rows in the order of their number; nside follows from the number of
    rows unless it is given, so that small catalogs do not end in thousands of files.  Other geometries go to files
    of a fixed number of rows.  A reader sees the dataset once the manifest is there.
    """
    spark = df.sparkSession
    check_contract(df.columns, geometry)
    if objects is not None or geometry in (Geometry.SIGHTLINE, Geometry.LIGHTCURVE):
        check_contract(objects.columns if objects is not None else [], geometry, "objects")
    out = prepare(out, overwrite)
    rows = rows_per_file or CHUNK_ROWS[geometry]
    if objects is not None:
        objects.write.option("compression", compression).parquet(str(out / "objects"))
    partitioning = None
    if geometry is Geometry.POINT:
        df = staged(standard_columns(df), "points")  # evaluated once
        bad = ~(sphere.finite(F.col("ra")) & sphere.finite(F.col("dec")))
        n, lost = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(bad.cast("int")), F.lit(0))).first()
        if lost:
            raise ValueError("rows without a finite position cannot be placed")
        nside = nside or cell_nside(n)
        partitioning = {"scheme": "healpix", "nside": nside, "ordering": "nested", "column": "healpix_cell"}
        placed = df.withColumn("healpix_cell", F.format_string("%05d", sphere.healpix_nest("ra", "dec", nside)))
        # by ranges of cell and row number, so that a crowded cell is written by several tasks
        tasks = max(1, min(n // max(1, rows // 2), 200_000))
        placed = placed.repartitionByRange(tasks, "healpix_cell", ROW_INDEX).sortWithinPartitions("healpix_cell", ROW_INDEX)
        placed.write.option("compression", compression).option("maxRecordsPerFile", rows).partitionBy("healpix_cell").parquet(str(out / "data"))
        time_column = time_column or ("t_obs" if "t_obs" in df.columns else None)
    else:
        keys = {Geometry.SIGHTLINE: ["sightline_id"], Geometry.LIGHTCURVE: ["object_id", "mjd"], Geometry.HEALPIX: ["healpix_index"]}[geometry]
        df.sort(*keys).write.option("compression", compression).option("maxRecordsPerFile", rows).parquet(str(out / "data"))
        time_column = "mjd" if geometry is Geometry.LIGHTCURVE else time_column
    for marker in list(out.rglob("_SUCCESS")) + list(out.rglob("*.crc")):
        marker.unlink()
    extra = dict(extra or {}) | ({"has_objects_table": True} if objects is not None else {})
    manifest = _manifest(spark, out, df, geometry, survey_name, survey_type, partitioning, temporal, validity, time_column, original_files, conversion_kwargs, loader, extra, stats)
    if geometry is Geometry.POINT:
        discard(df)
    log.info("%s: %d rows in %d files", survey_name, manifest.n_rows, manifest.n_partitions)
    return manifest


def write_sightlines(objects: DataFrame, data: DataFrame, out, survey_name: str, survey_type: str = "spectroscopic", **options) -> Manifest:
    return write_dataset(data, out, survey_name, survey_type, Geometry.SIGHTLINE, objects=objects, **options)


def write_sky_map(data: DataFrame, out, survey_name: str, survey_type: str = "map", nside: int = 256, ordering: str = "nested", coordsys: str = "icrs", **options) -> Manifest:
    extra = {"nside": nside, "ordering": ordering, "coordsys": coordsys}
    return write_dataset(data, out, survey_name, survey_type, Geometry.HEALPIX, extra=extra, **options)


def orphan_epochs(objects: DataFrame, epochs: DataFrame) -> DataFrame:
    return epochs.join(objects.select("object_id"), "object_id", "left_anti").select("object_id").distinct()


def epoch_statistics(objects: DataFrame, epochs: DataFrame) -> DataFrame:
    """Objects with n_epochs, mjd_min, mjd_max and their nside-32 cell."""
    per = epochs.groupBy("object_id").agg(F.count(F.lit(1)).cast("int").alias("n_epochs"), F.min("mjd").alias("mjd_min"), F.max("mjd").alias("mjd_max"))
    return objects.join(per, "object_id", "left").withColumn("_healpix32", sphere.healpix_nest("ra", "dec", 32).cast("int"))


def write_light_curves(objects: DataFrame, epochs: DataFrame, out, survey_name: str, survey_type: str = "photometric", **options) -> Manifest:
    """ValueError for epochs of unknown objects and for objects without epochs."""
    lost = [r["object_id"] for r in orphan_epochs(objects, epochs).orderBy("object_id").limit(5).collect()]
    if lost:
        raise ValueError(f"epochs of unknown objects, such as {lost}")
    full = epoch_statistics(objects, epochs)
    bare = [r["object_id"] for r in full.where("n_epochs is null").select("object_id").orderBy("object_id").limit(5).collect()]
    if bare:
        raise ValueError(f"objects without epochs, such as {bare}")
    return write_dataset(epochs, out, survey_name, survey_type, Geometry.LIGHTCURVE, objects=full, **options)


def source_rows(spark: SparkSession, path: str, kind: str) -> int:
    """Rows of a raw file: from a FITS header, or by counting the lines of a CSV file less its header."""
    if kind == "fits":
        from .fits import table_header

        return table_header(path)["n_rows"]
    return spark.read.option("header", "true").csv(path).count()
