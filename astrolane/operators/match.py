"""Positions matched by angle: the spherical join, redshift rules, and identities as connected components."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import sphere
from ..plans.staging import discard, staged
from .components import connected_components

Z_TYPES = ("spec", "phot", "pv", "none")


#: Cells are at least this many tolerances high and wide, so that few rows lie near a border.
CELL_TOLERANCES = 8


def _grid(df: DataFrame, tol: float, prefix: str, spread: bool) -> DataFrame:
    """Declination zones, each cut into bins of right ascension.

    spread: a copy for each neighbouring zone and bin whose border is within the tolerance (about 1.6 copies in all),
    so that an equi-join on (zone, bin) meets each near pair once.  Only numbers and literals are exploded, hence
    the cells are computed once a row.
    """
    height = max(CELL_TOLERANCES * tol, 0.002)
    reach = tol * 1.0001 + 1e-12
    dec = F.col(f"{prefix}dec")
    zone = F.floor(dec / height).cast("long")
    if spread:
        df = df.withColumn("__zone", zone)
        near = F.array(F.col("__zone"), F.when(dec - F.col("__zone") * height <= reach, F.col("__zone") - 1), F.when((F.col("__zone") + 1) * height - dec <= reach, F.col("__zone") + 1))
        df = df.withColumn("zone", F.explode(near)).where("zone is not null").drop("__zone")
    else:
        df = df.withColumn("zone", zone)
    z = F.col("zone")
    polar = F.least(F.lit(89.9999999), F.greatest(F.abs(z * height - height), F.abs((z + 2) * height)))
    df = df.withColumn("__width", 2 * F.degrees(F.asin(F.least(F.lit(1.0), F.sin(F.radians(F.lit(reach / 2))) / F.cos(F.radians(polar))))))
    bins = F.floor(360.0 / (CELL_TOLERANCES * F.greatest("__width", F.lit(1e-9)))).cast("long")
    df = df.withColumn("__bins", F.when(bins < 3, F.lit(1).cast("long")).otherwise(bins))
    df = df.withColumn("__at", F.pmod(F.col(f"{prefix}ra"), F.lit(360.0)) / 360.0 * F.col("__bins"))
    df = df.withColumn("__own", F.least(F.col("__bins") - 1, F.floor("__at").cast("long")))
    if spread:
        edge = F.col("__width") / 360.0 * F.col("__bins") * 1.0001 + 1e-9
        several = F.col("__bins") > 1
        near = F.array(F.col("__own"), F.when(several & (F.col("__at") - F.col("__own") <= edge), F.pmod(F.col("__own") - 1, F.col("__bins"))), F.when(several & (F.col("__own") + 1 - F.col("__at") <= edge), F.pmod(F.col("__own") + 1, F.col("__bins"))))
        df = df.withColumn("bin", F.explode(near)).where("bin is not null")
    else:
        df = df.withColumn("bin", F.col("__own"))
    return df.drop("__width", "__bins", "__at", "__own")


def spherical_join(left: DataFrame, right: DataFrame, tol_arcsec: float, condition: Column | None = None) -> DataFrame:
    """All pairs within the tolerance: left's columns with prefix l_, right's with r_, and sep_arcsec.

    Both sides need ra and dec; rows without finite ones match nothing.  The join is a sort-merge join on grid cells,
    which adaptive execution can split where the sky is dense; nothing is broadcast, whatever the sizes of the
    catalogs.  The smaller side belongs on the right.  condition: over the prefixed columns.
    """
    if not tol_arcsec > 0:
        raise ValueError("the tolerance must be positive")
    tol = tol_arcsec / sphere.ARCSEC
    sides = []
    for df, prefix, spread in ((left, "l_", False), (right, "r_", True)):
        placed = df.where(sphere.finite(F.col("ra")) & sphere.finite(F.col("dec")))
        named = placed.select(*[(F.col(f"`{c}`").cast("double") if c in ("ra", "dec") else F.col(f"`{c}`")).alias(prefix + c) for c in df.columns])
        sides.append(_grid(named, tol, prefix, spread))
    near = sides[0].join(sides[1].hint("merge"), ["zone", "bin"])
    if condition is not None:
        near = near.where(condition)
    sep = sphere.haversine("l_ra", "l_dec", "r_ra", "r_dec")
    return near.withColumn("sep_arcsec", sep * sphere.ARCSEC).where(F.col("sep_arcsec") <= tol_arcsec).drop("zone", "bin")


def digest(state: object) -> str:
    return hashlib.sha256(json.dumps(state, sort_keys=True).encode()).hexdigest()[:16]


@dataclass(frozen=True)
class MatchRules:
    """sky_tol_arcsec; the allowed redshift difference, by pair of redshift types or in general (None: no limit);
    pairs of types that never match."""

    sky_tol_arcsec: float = 1.0
    dz_tol: float | None = 1e-3
    dz_by_types: Mapping[tuple[str, str], float | None] = field(default_factory=dict)
    reject_types: frozenset = frozenset()

    def __post_init__(self):
        if not self.sky_tol_arcsec > 0:
            raise ValueError("sky_tol_arcsec must be positive")
        object.__setattr__(self, "dz_by_types", {tuple(sorted(k)): v for k, v in dict(self.dz_by_types).items()})
        object.__setattr__(self, "reject_types", frozenset(tuple(sorted(p)) for p in self.reject_types))

    def state(self) -> dict:
        return {"sky_tol_arcsec": self.sky_tol_arcsec, "dz_tol": self.dz_tol, "dz_by_types": sorted([*k, v] for k, v in self.dz_by_types.items()), "reject_types": sorted(map(list, self.reject_types))}

    @classmethod
    def from_state(cls, state: dict) -> "MatchRules":
        return cls(state["sky_tol_arcsec"], state["dz_tol"], {(a, b): v for a, b, v in state["dz_by_types"]}, frozenset(tuple(p) for p in state["reject_types"]))

    @property
    def hash(self) -> str:
        return digest(self.state())

    def __eq__(self, other) -> bool:
        return isinstance(other, MatchRules) and self.hash == other.hash

    def __hash__(self) -> int:
        return hash(self.hash)

    def accepts(self, type_a: Column, type_b: Column, z_a: Column, z_b: Column) -> Column:
        """A missing redshift keeps the pair: the sky position decides alone."""
        first, second = F.least(type_a, type_b), F.greatest(type_a, type_b)
        is_pair = lambda p: (first == p[0]) & (second == p[1])
        dz = F.abs(z_a.cast("double") - z_b.cast("double"))
        missing = dz.isNull() | F.isnan(dz)
        within = lambda tol: F.lit(True) if tol is None else missing | (dz <= float(tol))
        out = within(self.dz_tol)
        for pair, tol in sorted(self.dz_by_types.items()):
            out = F.when(is_pair(pair), within(tol)).otherwise(out)
        for pair in sorted(self.reject_types):
            out = F.when(is_pair(pair), F.lit(False)).otherwise(out)
        return out


def legacy_rules(rules: MatchRules | None, **old) -> MatchRules:
    """Rules as given, or from the older keywords sky_tol_arcsec and dz_tol; with either of them the tolerance in redshift is
    dz_tol, without a limit if it is None."""
    unknown = set(old) - {"sky_tol_arcsec", "dz_tol"}
    if unknown:
        raise TypeError(f"unknown keywords {sorted(unknown)}")
    if not old:
        return rules or MatchRules()
    if rules is not None:
        raise ValueError("either rules or the older keywords")
    default = MatchRules()
    return MatchRules(old.get("sky_tol_arcsec", default.sky_tol_arcsec), old["dz_tol"] if "dz_tol" in old else default.dz_tol)


def stacked(catalogs: Mapping[str, DataFrame], z_types: Mapping[str, str] | None = None) -> DataFrame:
    """dataset, row_index, ra, dec, z, z_type of all catalogs; the type is the row's own, the survey's, or none."""
    out = None
    whole = all("row_index" not in df.columns or isinstance(df.schema["row_index"].dataType, T.IntegralType) for df in catalogs.values())
    for name in sorted(catalogs):
        df = catalogs[name]
        for c in ("row_index", "ra", "dec"):
            if c not in df.columns:
                raise KeyError(c)
        z = F.col("z").cast("double") if "z" in df.columns else F.lit(None).cast("double")
        own = F.col("z_type").cast("string") if "z_type" in df.columns else F.lit(None).cast("string")
        part = df.select(F.lit(name).alias("dataset"), F.col("row_index").cast("long" if whole else "string").alias("row_index"), F.col("ra").cast("double").alias("ra"), F.col("dec").cast("double").alias("dec"), F.when(~F.isnan(z), z).alias("z"), F.coalesce(own, F.lit((z_types or {}).get(name)), F.lit("none")).alias("z_type"))
        out = part if out is None else out.unionByName(part)
    return out


def matched_pairs(rows: DataFrame, rules: MatchRules, names: Sequence[str] | None = None) -> DataFrame:
    """Pairs of rows of different datasets that the rules accept, each once, the smaller dataset on the left.

    names: all datasets, if they are known; the last one is then never read on the left, nor the first on the right.
    """
    condition = (F.col("l_dataset") < F.col("r_dataset")) & rules.accepts(F.col("l_z_type"), F.col("r_z_type"), F.col("l_z"), F.col("r_z"))
    left, right = (rows.where(F.col("dataset") != max(names)), rows.where(F.col("dataset") != min(names))) if names else (rows, rows)
    return spherical_join(left, right, rules.sky_tol_arcsec, condition)


@dataclass
class MatchResult:
    """rows: uid, dataset, row_index, ra, dec, z, z_type.  Counts are asked for, not kept."""

    rows: DataFrame
    rules: MatchRules

    def group(self, uid: int) -> DataFrame:
        return self.rows.where(F.col("uid") == uid)

    def multi_survey(self) -> DataFrame:
        several = self.rows.groupBy("uid").agg(F.countDistinct("dataset").alias("n")).where("n > 1").select("uid")
        return self.rows.join(several, "uid", "left_semi")

    def counts(self) -> dict[str, int]:
        per = self.rows.groupBy("uid").agg(F.countDistinct("dataset").alias("n"))
        r = per.agg(F.count(F.lit(1)).alias("u"), F.coalesce(F.sum((F.col("n") > 1).cast("long")), F.lit(0)).alias("m")).first()
        return {"n_unique": r["u"], "n_multi": r["m"]}


def dense_ids(keys: DataFrame, order: list[str], name: str) -> DataFrame:
    """keys with 0, 1, ... in the order of `order`, which must be unique: counts of range partitions, then ranks inside.

    No partition is larger than its share, unlike a rank over all rows.
    """
    dealt = staged(keys.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "dense-keys")
    sizes = dealt.groupBy("__part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    bases = sizes.select("__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__base"))
    inside = Window.partitionBy("__part").orderBy(*order)
    ranked = dealt.withColumn("__rank", F.row_number().over(inside) - 1)
    return ranked.join(F.broadcast(bases), "__part").withColumn(name, (F.col("__base") + F.col("__rank")).cast("long")).drop("__part", "__base", "__rank")


def cross_match(catalogs: Mapping[str, DataFrame], rules: MatchRules = MatchRules(), z_types: Mapping[str, str] | None = None) -> MatchResult:
    """Universal ids over all catalogs: rows that accepted pairs connect, directly or through others, share a uid.

    uids are 0 .. n-1 in the order of each object's smallest (dataset, row_index).  row_index may be any integer, or a
    string (then the result's is one).  No catalogs: no rows.
    """
    if not catalogs:
        spark = SparkSession.getActiveSession()
        return MatchResult(spark.createDataFrame([], "uid long, dataset string, row_index long, ra double, dec double, z double, z_type string"), rules)
    rows = staged(dense_ids(stacked(catalogs, z_types), ["dataset", "row_index", "ra", "dec", "z"], "node"), "stacked")
    edges = matched_pairs(rows, rules, sorted(catalogs)).select(F.col("l_node").alias("a"), F.col("r_node").alias("b"))
    parts = connected_components(edges)
    labelled = staged(rows.join(parts, "node", "left").withColumn("first", F.coalesce("component", "node")).drop("component"), "labelled")
    discard(rows)
    ids = dense_ids(labelled.where("node = first").select("first"), ["first"], "uid")
    return MatchResult(labelled.join(ids, "first").select("uid", "dataset", "row_index", "ra", "dec", "z", "z_type"), rules)
