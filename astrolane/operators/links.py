"""Directed links from child objects to hosts: a spherical join with a redshift rule and counted ambiguity."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sphere
from ..sources.validity import Validity
from .match import digest, spherical_join


@dataclass(frozen=True)
class LinkRules:
    parent_survey_type: str
    child_survey_type: str
    sky_tol_arcsec: float = 1.0
    dz_tol: float | None = 5e-3
    relation: str = "contains"
    accept_ambiguous: bool = False

    def __post_init__(self):
        if not self.sky_tol_arcsec > 0 or (self.dz_tol is not None and not self.dz_tol > 0):
            raise ValueError("tolerances must be positive")
        if not self.relation:
            raise ValueError("a relation needs a name")

    def state(self) -> dict:
        return dict(self.__dict__)

    @property
    def hash(self) -> str:
        return digest(self.state())


def link(parents: DataFrame, children: DataFrame, rules: LinkRules, across_datasets: bool = False) -> DataFrame:
    """parents and children: dataset, uid, ra, dec, z -> parent, child, parent_dataset, child_dataset, relation,
    confidence, sky_sep_arcsec, dz (floats).

    With a limit and a finite child redshift, only parents with a finite one within the limit count; a child
    without a redshift goes by position.  Several parents: none is linked unless ambiguity is accepted, then each
    with confidence 1 / n.  n counts within a pair of datasets, or over all parents if across_datasets is set.
    """
    near = spherical_join(parents.select("dataset", "uid", "ra", "dec", F.col("z").cast("double").alias("z")), children.select("dataset", "uid", "ra", "dec", F.col("z").cast("double").alias("z")), rules.sky_tol_arcsec)
    dz = F.col("l_z") - F.col("r_z")
    if rules.dz_tol is None:
        near, signed = near, F.lit(None).cast("double")
    else:
        child = sphere.finite(F.col("r_z"))
        near = near.where(~child | (sphere.finite(F.col("l_z")) & (F.abs(dz) <= rules.dz_tol)))
        signed = F.when(child, dz)
    per = ["r_dataset", "r_uid"] if across_datasets else ["l_dataset", "r_dataset", "r_uid"]
    counted = near.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*per)))
    if not rules.accept_ambiguous:
        counted = counted.where("n = 1")
    return counted.select(
        F.col("l_uid").alias("parent"), F.col("r_uid").alias("child"), F.col("l_dataset").alias("parent_dataset"), F.col("r_dataset").alias("child_dataset"), F.lit(rules.relation).alias("relation"),
        (1.0 / F.col("n")).cast("float").alias("confidence"), F.col("sep_arcsec").cast("float").alias("sky_sep_arcsec"), signed.cast("float").alias("dz"),
    )


def first_rows(index_rows: DataFrame, datasets: list[str]) -> DataFrame:
    """The index's rows of some datasets, one per uid: the first in the order of dataset and row."""
    rows = index_rows.where(F.col("dataset").isin(sorted(datasets)))
    best = rows.groupBy("uid", "dataset").agg(F.min(F.struct("row_index", "ra", "dec", "z")).alias("r"))
    return best.select("dataset", "uid", "r.ra", "r.dec", "r.z")


@dataclass(frozen=True)
class LinkSet:
    rows: DataFrame
    rules: LinkRules
    name: str = "default"
    validity: Validity | None = None
    identity_hash: str | None = None

    def children_of(self, parent: int) -> list[int]:
        found = self.rows.where(F.col("parent") == parent).orderBy(F.desc("confidence"), "child").select("child").collect()
        return [r["child"] for r in found]

    def parent_of(self, child: int) -> None | int | list[int]:
        found = self.rows.where(F.col("child") == child).orderBy(F.desc("confidence"), "parent").select("parent").collect()
        return None if not found else found[0]["parent"] if len(found) == 1 else [r["parent"] for r in found]

    def __repr__(self) -> str:
        return f"LinkSet({self.name!r}, rules {self.rules.hash})"
