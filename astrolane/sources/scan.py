"""Lazy scans of one dataset: files pruned by the manifest, predicates that reach the Parquet reader."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.selection import Cone, SkyPatch, cells_of, in_range
from .manifest import DataFile, Manifest, read_manifest
from .schema import Geometry

ROW_INDEX = "_original_row_index"


def _overlaps(p: DataFile, name: str, wanted: tuple | None) -> bool:
    have = p.ranges.get(name)
    if wanted is None or not have or None in have:
        return True
    low, high = wanted
    return (high is None or have[0] <= high) and (low is None or have[1] >= low)


@dataclass(frozen=True)
class DatasetView:
    spark: SparkSession
    path: Path
    manifest: Manifest

    @classmethod
    def open(cls, spark: SparkSession, path: str | Path) -> "DatasetView":
        return cls(spark, Path(path), read_manifest(path))

    from_path = open

    @property
    def geometry(self) -> Geometry:
        return self.manifest.geometry

    @property
    def n_rows(self) -> int:
        return self.manifest.n_rows

    @property
    def n_partitions(self) -> int:
        return self.manifest.n_partitions

    @property
    def columns(self) -> list[str]:
        return self.manifest.schema.names

    @property
    def survey_name(self) -> str:
        return self.manifest.survey_name

    def pruned(self, cells: list[int] | None = None, ra=None, dec=None, z=None, t=None) -> list[DataFile]:
        """The files that can hold rows of the cells and ranges."""
        wanted = None if cells is None else set(cells)
        keep = lambda p: (wanted is None or p.cell is None or p.cell in wanted) and all(_overlaps(p, n, r) for n, r in (("ra", ra), ("dec", dec), ("z", z), ("t", t)))
        return [p for p in self.manifest.files if keep(p)]

    def scan(self, columns: list[str] | None = None, filter: Column | str | None = None, *, ra_range=None, dec_range=None, z_range=None, t_range=None, cone: Cone | None = None, skypatch: SkyPatch | None = None, healpix_cells: list[int] | None = None, narrow_cells: bool = False) -> DataFrame:
        """Rows that satisfy everything given.  The cells of a cone, a patch and an explicit list are united for
        pruning (intersected if narrow_cells); row predicates are all required.  Nothing is read until an action.

        A time range filters rows only where the manifest names a time column.  No file left: no rows, same types.
        """
        nside = self.manifest.nside or 32
        cells = cells_of(cone, skypatch, healpix_cells, nside, narrow_cells)
        parts = self.pruned(cells, ra_range, dec_range, z_range, t_range)
        rows = self._files(parts)
        tests = [in_range(c, *r) for c, r in (("ra", ra_range), ("dec", dec_range), ("z", z_range)) if r is not None]
        if t_range is not None and self.manifest.temporal is not None:
            tests.append(in_range(self.manifest.temporal.time_column, *t_range))
        tests += [s.column() for s in (cone, skypatch) if s is not None]
        if filter is not None:
            tests.append(F.expr(filter) if isinstance(filter, str) else filter)
        if healpix_cells is not None and self.geometry is Geometry.HEALPIX:
            tests.append(F.col("healpix_index").isin(healpix_cells))
        if tests:
            rows = rows.where(reduce(lambda a, b: a & b, tests))
        return rows.select(*columns) if columns is not None else rows

    def _files(self, parts: list[DataFile]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], self.manifest.schema)
        return self.spark.read.schema(self.manifest.schema).parquet(*[str(self.path / p.path) for p in parts])

    def read(self, *args, **kwargs):
        """scan() as a pandas frame."""
        return self.scan(*args, **kwargs).toPandas()

    def objects(self, columns: list[str] | None = None) -> DataFrame:
        """One row per sightline or light curve."""
        if self.geometry not in (Geometry.SIGHTLINE, Geometry.LIGHTCURVE):
            raise ValueError(f"{self.geometry.value} datasets have no objects table")
        rows = self.spark.read.parquet(str(self.path / "objects"))
        return rows.select(*columns) if columns else rows

    def __repr__(self) -> str:
        return f"DatasetView({self.survey_name!r}, {self.geometry.value}, {self.n_rows} rows)"


def read_points(spark: SparkSession, path: str | Path, columns: list[str] | None = None, filter=None) -> DataFrame:
    """All files of a dataset in the order of their row numbers, which are there under the name row_index as well."""
    view = DatasetView.open(spark, path)
    rows = view.scan(filter=filter)
    rows = rows.withColumn("row_index", F.col(ROW_INDEX)).orderBy(ROW_INDEX) if ROW_INDEX in view.columns else rows
    return rows.select(*columns) if columns else rows


def read_objects(spark: SparkSession, path: str | Path, columns: list[str] | None = None) -> DataFrame:
    """The objects table of a dataset that says it has one."""
    view = DatasetView.open(spark, path)
    if not view.manifest.notes.get("has_objects_table"):
        raise ValueError(f"{path} has no objects table")
    return view.objects(columns)


def original_columns(spark: SparkSession, path: str | Path, columns: list[str], row_indices: list[int] | DataFrame) -> DataFrame:
    """Columns of the dataset's first original file for some row numbers, joined on the number of the row."""
    from .fits import read_fits
    from .ingest import numbered_csv

    files = read_manifest(path).sources
    if not files:
        raise ValueError("the manifest names no original file")
    first = files[0]
    source = read_fits(spark, first["path"]) if first.get("format") == "fits" else numbered_csv(spark, first["path"])
    rows = row_indices if isinstance(row_indices, DataFrame) else spark.createDataFrame([(int(i),) for i in row_indices], f"{ROW_INDEX} long")
    return source.join(rows, ROW_INDEX, "left_semi").select(ROW_INDEX, *columns)
