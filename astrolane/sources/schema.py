"""Column groups and the contracts of each geometry."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum

from pyspark.sql import types as T


class Geometry(str, Enum):
    POINT = "point"
    SIGHTLINE = "sightline"
    HEALPIX = "healpix"
    LIGHTCURVE = "lightcurve"


@dataclass(frozen=True)
class ColumnSpec:
    name: str
    dtype: str
    unit: str = ""
    required: bool = True


#: The columns of each group.
GROUPS: dict[str, tuple[ColumnSpec, ...]] = {
    "core": (
        ColumnSpec("ra", "f8", "deg"),
        ColumnSpec("dec", "f8", "deg"),
        ColumnSpec("z", "f4"),
        ColumnSpec("z_type", "U8"),
        ColumnSpec("z_err", "f4"),
        ColumnSpec("galaxy_id", "i8"),
        ColumnSpec("survey_id", "U32"),
        ColumnSpec("_original_row_index", "i8"),
        ColumnSpec("_healpix32", "i4"),
    ),
    "spectroscopic": (
        ColumnSpec("z_spec", "f4"),
        ColumnSpec("z_spec_err", "f4"),
        ColumnSpec("z_helio", "f4", required=False),
        ColumnSpec("z_cmb", "f4", required=False),
        ColumnSpec("cz_cmb", "f4", "km/s", required=False),
        ColumnSpec("w_fkp", "f4", required=False),
        ColumnSpec("w_comp", "f4", required=False),
        ColumnSpec("w_cp", "f4", required=False),
        ColumnSpec("w_noz", "f4", required=False),
        ColumnSpec("w_sys", "f4", required=False),
        ColumnSpec("w_tot", "f4", required=False),
    ),
    "photometric": (
        ColumnSpec("z_phot", "f4"),
        ColumnSpec("z_phot_err", "f4"),
        ColumnSpec("z_phot_l68", "f4", required=False),
        ColumnSpec("z_phot_u68", "f4", required=False),
        ColumnSpec("odds", "f4", required=False),
    ),
    "peculiar_velocity": (
        ColumnSpec("v_pec", "f4", "km/s"),
        ColumnSpec("v_pec_err", "f4", "km/s"),
        ColumnSpec("mu", "f4", "mag", required=False),
        ColumnSpec("mu_err", "f4", "mag", required=False),
        ColumnSpec("mu_method", "U8", required=False),
    ),
    "qso": (
        ColumnSpec("is_qso", "i1"),
        ColumnSpec("source_z", "U16", required=False),
        ColumnSpec("z_pipe", "f8", required=False),
        ColumnSpec("z_pca", "f8", required=False),
        ColumnSpec("z_vi", "f8", required=False),
        ColumnSpec("z_conf", "i1", required=False),
        ColumnSpec("zwarning", "i4", required=False),
        ColumnSpec("bal_prob", "f4", required=False),
        ColumnSpec("bi_civ", "f8", "km/s", required=False),
        ColumnSpec("z_mgii", "f8", required=False),
        ColumnSpec("z_ciii", "f8", required=False),
        ColumnSpec("z_civ", "f8", required=False),
        ColumnSpec("z_lya", "f8", required=False),
        ColumnSpec("psfmag_u", "f4", "mag", required=False),
        ColumnSpec("psfmag_g", "f4", "mag", required=False),
        ColumnSpec("psfmag_r", "f4", "mag", required=False),
        ColumnSpec("psfmag_i", "f4", "mag", required=False),
        ColumnSpec("psfmag_z", "f4", "mag", required=False),
        ColumnSpec("extinction_u", "f4", "mag", required=False),
        ColumnSpec("extinction_g", "f4", "mag", required=False),
        ColumnSpec("extinction_r", "f4", "mag", required=False),
        ColumnSpec("extinction_i", "f4", "mag", required=False),
        ColumnSpec("extinction_z", "f4", "mag", required=False),
        ColumnSpec("plate", "i4", required=False),
        ColumnSpec("mjd", "i4", "d", required=False),
        ColumnSpec("fiberid", "i2", required=False),
        ColumnSpec("sn_median", "f4", required=False),
        ColumnSpec("n_dla", "i1", required=False),
    ),
    "snia": (
        ColumnSpec("z_cmb", "f4"),
        ColumnSpec("mu", "f4", "mag"),
        ColumnSpec("mu_err", "f4", "mag"),
        ColumnSpec("x1", "f4", required=False),
        ColumnSpec("x1_err", "f4", required=False),
        ColumnSpec("c", "f4", required=False),
        ColumnSpec("c_err", "f4", required=False),
        ColumnSpec("mb", "f4", "mag", required=False),
        ColumnSpec("mb_err", "f4", "mag", required=False),
    ),
}
Z_TYPES = ("spec", "phot", "pv", "none")

#: Columns that the tables of a geometry must have.
CONTRACTS: dict[Geometry, dict[str, tuple[str, ...]]] = {
    Geometry.POINT: {
        "data": ("ra", "dec", "z", "z_type", "z_err"),
    },
    Geometry.SIGHTLINE: {
        "objects": ("sightline_id", "ra", "dec", "z_source", "survey_id", "n_pixels"),
        "data": ("sightline_id", "loglam", "delta", "weight"),
    },
    Geometry.HEALPIX: {
        "data": ("healpix_index", "value"),
    },
    Geometry.LIGHTCURVE: {
        "objects": ("object_id", "ra", "dec", "z", "z_type", "z_err", "n_epochs", "mjd_min", "mjd_max", "_healpix32"),
        "data": ("object_id", "mjd", "filter", "flux", "flux_err", "flag"),
    },
}
#: Rows per file.
CHUNK_ROWS = {Geometry.POINT: 200_000, Geometry.SIGHTLINE: 2_000_000, Geometry.HEALPIX: 500_000, Geometry.LIGHTCURVE: 1_000_000}

_SPARK = {"f8": T.DoubleType(), "f4": T.FloatType(), "i8": T.LongType(), "i4": T.IntegerType(), "i2": T.ShortType(), "i1": T.ByteType()}


def spark_type(dtype: str) -> T.DataType:
    return T.StringType() if dtype.startswith("U") else _SPARK[dtype]


def group_type(name: str) -> T.StructType:
    return T.StructType([T.StructField(c.name, spark_type(c.dtype), True, {"unit": c.unit}) for c in GROUPS[name]])


def columns_of(groups: tuple[str, ...], required: bool = True) -> list[str]:
    return list(dict.fromkeys(c.name for g in groups for c in GROUPS[g] if c.required or not required))


def _kind(t: T.DataType) -> str:
    return "f" if isinstance(t, (T.DoubleType, T.FloatType)) else "i" if isinstance(t, T.IntegralType) else "U" if isinstance(t, T.StringType) else "?"


def validate(df, groups: tuple[str, ...], ignore: tuple[str, ...] = ("_original_row_index", "_healpix32", "z_err")) -> list[str]:
    """ValueError for missing required columns; a warning for each column of another kind.  Runs no job."""
    have = {f.name: f.dataType for f in df.schema.fields}
    missing = [c for c in columns_of(groups) if c not in have and c not in ignore]
    if missing:
        raise ValueError(f"missing columns {missing}")
    kinds = {c.name: _kind(spark_type(c.dtype)) for g in groups for c in GROUPS[g]}
    return [f"{c}: {have[c].simpleString()} where {k} is expected" for c, k in kinds.items() if c in have and _kind(have[c]) != k and not (k == "f" and _kind(have[c]) == "i")]


def check_contract(columns: list[str], geometry: Geometry, table: str = "data") -> None:
    wanted = CONTRACTS[geometry].get(table)
    if wanted is None:
        raise ValueError(f"{geometry.value} datasets have no {table} table")
    missing = [c for c in wanted if c not in columns]
    if missing:
        raise ValueError(f"{geometry.value} {table} lacks {missing}")
