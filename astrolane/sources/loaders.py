"""Survey loaders: declared catalogs, a registry, and the pipelines that bring raw tables into standard columns."""

from __future__ import annotations

import os
from dataclasses import dataclass, field
from pathlib import Path
from types import MappingProxyType

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import photometry
from ..operators.selection import selected
from . import schema
from .ingest import ROW_INDEX
from .manifest import NAME as MANIFEST
from .scan import DatasetView

DATA_ROOT_ENV = "ASTROLANE_DATA_ROOT"
_root: list[Path | None] = [None]


def set_data_root(path: str | Path | None) -> None:
    _root[0] = None if path is None else Path(path)


def data_root() -> Path | None:
    """What was set, else the environment's, else None."""
    return _root[0] or (Path(os.environ[DATA_ROOT_ENV]) if os.environ.get(DATA_ROOT_ENV) else None)


@dataclass(frozen=True)
class SurveyConfig:
    name: str
    survey_type: str
    groups: tuple[str, ...]
    data_format: str
    approx_rows: int
    description: str = ""
    file_name: str = ""
    fields: dict[str, str] = field(default_factory=dict)

    @property
    def subpath(self) -> str:
        return f"{self.survey_type}/{self.name}"


class SurveyLoader:
    """Subclass with `config` and raw(); load() validates, selects rows, then columns."""

    config: SurveyConfig

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def raw(self, path: str | None, **options) -> DataFrame:
        raise NotImplementedError(f"{self.config.name} has no reader for its raw files yet")

    def _place(self, path) -> Path | None:
        return Path(path) if path else data_root() and data_root() / self.config.subpath

    def load(self, selection=None, columns: list[str] | None = None, validate: bool = True, path: str | None = None, force_native: bool = False, **options) -> DataFrame:
        """From converted Parquet where it exists, unless force_native; else from the raw file."""
        place = self._place(path)
        if not force_native and place is not None and (place / MANIFEST).exists():
            rows = DatasetView.open(self.spark, place).scan()
        else:
            rows = self.raw(str(place / self.config.file_name) if place is not None and place.is_dir() and self.config.file_name else place and str(place), **options)
        if validate:
            schema.validate(rows, self.config.groups)
        rows = rows.where(selected(selection))
        if columns is None:
            return rows
        unknown = [c for c in columns if c not in rows.columns]
        if unknown:
            raise ValueError(f"unknown columns {unknown}")
        return rows.select(*columns)

    def available_columns(self) -> list[str]:
        return list(dict.fromkeys([*schema.columns_of(self.config.groups, required=False), *self.config.fields]))

    def info(self) -> str:
        c = self.config
        return f"{c.name} ({c.survey_type}, {c.data_format}, about {c.approx_rows:,} rows): {c.description}\ncolumns: {', '.join(self.available_columns())}"


_REGISTRY: dict[str, type[SurveyLoader]] = {}
REGISTRY = MappingProxyType(_REGISTRY)


def register(loader: type[SurveyLoader]) -> type[SurveyLoader]:
    name = loader.config.name
    if name in _REGISTRY:
        raise ValueError(f"{name} is registered already")
    _REGISTRY[name] = loader
    return loader


def get_loader(name: str) -> type[SurveyLoader]:
    if name not in _REGISTRY:
        raise KeyError(f"{name}; there are {sorted(_REGISTRY)}")
    return _REGISTRY[name]


def list_surveys(survey_type: str | None = None) -> list[str]:
    return sorted(n for n, c in _REGISTRY.items() if survey_type in (None, c.config.survey_type))


def list_survey_types() -> list[str]:
    return sorted({c.config.survey_type for c in _REGISTRY.values()})


def survey_config(name: str) -> SurveyConfig:
    return get_loader(name).config


def load_catalog(spark: SparkSession, survey: str, selection=None, columns: list[str] | None = None, validate: bool = True, **options) -> DataFrame:
    return get_loader(survey)(spark).load(selection, columns, validate, **options)


def _lowered(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.select(*[F.col(c).alias(c if c == ROW_INDEX else names.get(c, c.lower())) for c in df.columns])


def _cut(df: DataFrame, z_min: float | None, z_max: float | None) -> DataFrame:
    df = df.where(F.col("z") >= z_min) if z_min is not None else df
    return df.where(F.col("z") <= z_max) if z_max is not None else df


@register
class DesiQso(SurveyLoader):
    #: Raw columns whose names are not the lower-case ones.
    names = {"Z_RR": "z", "ZERR": "z_spec_err", "ZWARN": "zwarning", "WEIGHT_ZFAIL": "w_zfail"}
    config = SurveyConfig("desi_qso", "spectroscopic", ("core", "spectroscopic"), "fits", 2_332_000, "DESI DR1 quasars")

    def raw(self, path, qso_only: bool = True, good_zwarn: bool = True, z_min: float | None = None, z_max: float | None = None):
        from .fits import read_fits

        return self.standard(read_fits(self.spark, path), qso_only, good_zwarn, z_min, z_max)

    def standard(self, table: DataFrame, qso_only=True, good_zwarn=True, z_min=None, z_max=None) -> DataFrame:
        rows = _lowered(table, self.names)
        rows = rows.where(F.trim("spectype") == "QSO") if qso_only else rows
        rows = rows.where("zwarning = 0") if good_zwarn else rows
        rows = _cut(rows, z_min, z_max)
        rows = rows.withColumns({f"mag_{b}": photometry.flux_to_magnitude(f"flux_{b}") for b in "grz" if f"flux_{b}" in rows.columns})
        return rows.withColumns({"z_type": F.lit("spec"), "galaxy_id": F.col(ROW_INDEX), "survey_id": F.lit("desi_qso"), "z_spec": F.col("z").cast("float")})


@register
class EbossQso(SurveyLoader):
    #: Raw columns whose names are not the lower-case ones.
    names = {"IS_QSO_FINAL": "is_qso", "SN_MEDIAN_ALL": "sn_median"}
    config = SurveyConfig("eboss_qso", "spectroscopic", ("core", "spectroscopic", "qso"), "fits", 920_000, "eBOSS DR16 quasars", "DR16Q_Superset_v3.fits")

    def raw(self, path, qso_only: bool = True, z_min: float | None = None, z_max: float | None = None):
        from .fits import read_fits

        return self.standard(read_fits(self.spark, path, where={"IS_QSO_FINAL": 1} if qso_only else None), z_min, z_max)

    def standard(self, table: DataFrame, z_min=None, z_max=None) -> DataFrame:
        """Vector columns become one column per band and a count of absorbers."""
        rows = _lowered(table, self.names)
        for vector in ("psfmag", "extinction"):
            if vector in rows.columns:
                rows = rows.select("*", *photometry.bands(vector, vector)).drop(vector)
        if "z_dla" in rows.columns:
            rows = rows.withColumn("n_dla", photometry.count_positive("z_dla"))
        rows = _cut(rows, z_min, z_max)
        return rows.withColumns({"z_type": F.lit("spec"), "galaxy_id": F.col(ROW_INDEX), "survey_id": F.lit("eboss_qso"), "z_spec": F.col("z").cast("float"), "z_spec_err": F.lit(0.0).cast("float")})


@register
class Dummy(SurveyLoader):
    """An invented survey: the same rows for the same number and seed, made by hashing row numbers."""

    config = SurveyConfig("dummy", "test", ("core", "spectroscopic", "peculiar_velocity"), "in-memory", 5_000, "Invented nearby galaxies")

    def raw(self, path=None, n: int = 5_000, seed: int = 42, z_min: float = 0.005, z_max: float = 0.15):
        u = lambda i: F.pmod(F.xxhash64(F.col("id"), F.lit(seed), F.lit(i)), F.lit(1 << 40)).cast("double") / float(1 << 40)
        rows = self.spark.range(n).select("id", (u(1) * 360).alias("ra"), F.degrees(F.asin(u(2) * 2 - 1)).alias("dec"), photometry.sampled_redshift(u(3), z_min, z_max).alias("z"), (u(4) * 0.2 + 0.1).alias("mu_err"), (u(5) * 600 - 300).alias("v_pec"))
        return rows.select(
            F.col("id").alias(ROW_INDEX), F.col("id").alias("galaxy_id"), F.lit("dummy").alias("survey_id"), "ra", "dec", F.col("z").cast("float").alias("z"), F.lit("spec").alias("z_type"), F.lit(1e-4).cast("float").alias("z_err"), F.col("z").cast("float").alias("z_spec"), F.lit(1e-4).cast("float").alias("z_spec_err"),
            F.col("v_pec").cast("float").alias("v_pec"), photometry.velocity_error("mu_err", "z").cast("float").alias("v_pec_err"), photometry.distance_modulus(photometry.hubble_distance("z")).cast("float").alias("mu"), F.col("mu_err").cast("float").alias("mu_err"),
        )


def _declared(name, survey_type, groups, data_format, rows, description):
    register(type("".join(p.title() for p in name.split("_")), (SurveyLoader,), {"config": SurveyConfig(name, survey_type, groups, data_format, rows, description)}))


#: Surveys that are declared, without a reader yet.
_declared("desi_bgs", "spectroscopic", ("core", "spectroscopic"), "fits", 15_000_000, "DESI bright galaxies")
_declared("sdss_mgs", "spectroscopic", ("core", "spectroscopic"), "fits", 700_000, "SDSS main galaxies")
_declared("sixdfgs", "spectroscopic", ("core", "spectroscopic"), "fits", 136_000, "6dF galaxies")
_declared("des_dr2", "photometric", ("core", "photometric"), "parquet", 700_000_000, "DES DR2 objects")
_declared("cosmicflows4", "peculiar_velocity", ("core", "peculiar_velocity"), "fits", 56_000, "Cosmicflows-4 distances")
_declared("desi_pv", "peculiar_velocity", ("core", "spectroscopic", "peculiar_velocity"), "fits", 150_000, "DESI peculiar velocities")
_declared("pantheonplus", "snia", ("core", "peculiar_velocity"), "csv", 1_700, "Pantheon+ supernovae")

