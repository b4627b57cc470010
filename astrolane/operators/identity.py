"""The identity index, uid to rows of datasets, and queries over it from ids to full attributes."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.validity import Validity
from .match import MatchResult, MatchRules, dense_ids
from .selection import Cone, Shell, SkyPatch, selected


@dataclass(frozen=True)
class IdentityIndex:
    """rows: uid, dataset, row_index, ra, dec, z, z_type, survey_type."""

    rows: DataFrame
    rules: MatchRules
    name: str = "default"
    validity: Validity | None = None
    names: tuple[str, ...] | None = None
    stored_counts: tuple[int, int] | None = None

    @property
    def sky_tol_arcsec(self) -> float:
        return self.rules.sky_tol_arcsec

    @property
    def dz_tol(self) -> float | None:
        return self.rules.dz_tol

    def datasets(self) -> list[str]:
        """The names that the index was stored with, else those of its rows."""
        if self.names is not None:
            return sorted(self.names)
        return [r["dataset"] for r in self.rows.select("dataset").distinct().orderBy("dataset").collect()]

    def of(self, uid: int) -> DataFrame:
        return self.rows.where(F.col("uid") == uid)

    concurrences = of

    def counts(self) -> dict[str, int]:
        """Objects, and objects of several datasets: as stored, else counted."""
        if self.stored_counts is not None:
            return dict(zip(("n_unique", "n_multi"), self.stored_counts, strict=True))
        return MatchResult(self.rows, self.rules).counts()

    def lookup(self, dataset: str, row_index: int) -> int:
        found = self.rows.where((F.col("dataset") == dataset) & (F.col("row_index") == row_index)).select("uid").take(1)
        if not found:
            raise KeyError((dataset, row_index))
        return found[0]["uid"]

    def multi_only(self) -> DataFrame:
        several = self.rows.groupBy("uid").agg(F.countDistinct("dataset").alias("n")).where("n > 1").select("uid")
        return self.rows.join(several, "uid", "left_semi")

    def restrict_to(self, datasets: Iterable[str]) -> "IdentityIndex":
        """The rows of some datasets, uids made dense again; keeps rules and validity."""
        rows = self.rows.where(F.col("dataset").isin(sorted(datasets)))
        ids = dense_ids(rows.select("uid").distinct(), ["uid"], "dense")
        return replace(self, rows=rows.join(ids, "uid").withColumn("uid", F.col("dense")).drop("dense"), names=None, stored_counts=None)

    def __repr__(self) -> str:
        return f"IdentityIndex({self.name!r}, rules {self.rules.hash})"


@dataclass(frozen=True)
class IdentityQuery:
    """Selects uids, then hydrates them: index rows, chosen columns, or all columns.

    open_dataset: name -> DataFrame with row_index and the dataset's columns.  Results of selectors are DataFrames of
    distinct uids; nothing is collected but what from_id and lookup name.
    """

    index: IdentityIndex
    open_dataset: Callable[[str], DataFrame] | Mapping[str, DataFrame] | None = None

    def _dataset(self, name: str) -> DataFrame:
        return self.open_dataset[name] if isinstance(self.open_dataset, Mapping) else self.open_dataset(name)

    def _uids(self, values: Iterable[int] | DataFrame) -> DataFrame:
        if isinstance(values, DataFrame):
            return values.select("uid").distinct()
        if isinstance(values, range):
            return self.index.rows.sparkSession.range(values.start, values.stop, values.step).toDF("uid")
        return self.index.rows.sparkSession.createDataFrame([(int(v),) for v in sorted(set(values))], "uid long")

    def from_id(self, uid: int) -> DataFrame:
        if not self.index.of(uid).take(1):
            raise KeyError(uid)
        return self._uids([uid])

    def from_ids(self, uids: Iterable[int] | DataFrame) -> DataFrame:
        """Those of the uids that the index holds."""
        return self._uids(uids).join(self.index.rows.select("uid"), "uid", "left_semi")

    def from_foreign_ids(self, dataset: str, row_indices: Iterable[int] | DataFrame) -> DataFrame:
        rows = row_indices if isinstance(row_indices, DataFrame) else self.index.rows.sparkSession.createDataFrame([(int(r),) for r in row_indices], "row_index long")
        return self.index.rows.where(F.col("dataset") == dataset).join(rows.select("row_index").distinct(), "row_index", "left_semi").select("uid").distinct()

    def from_selection(self, selections) -> DataFrame:
        """Objects of which any one row satisfies all predicates."""
        return self.index.rows.where(selected(selections)).select("uid").distinct()

    def from_cone(self, *args) -> DataFrame:
        return self.from_selection(Cone(*args))

    def from_shell(self, *args) -> DataFrame:
        return self.from_selection(Shell(*args))

    def from_skypatch(self, *args) -> DataFrame:
        return self.from_selection(SkyPatch(*args))

    def index_for(self, uids) -> DataFrame:
        return self.index.rows.join(self._uids(uids), "uid", "left_semi")

    def partial_for(self, uids, columns: list[str], datasets: Iterable[str] | None = None) -> DataFrame:
        """Index rows with columns of their datasets; the index's ra, dec and z win, absent columns and rows are null."""
        rows = self.index_for(uids)
        names = self.index.datasets() if datasets is None else sorted(datasets)
        base = rows.columns
        wanted = [c for c in columns if c not in base]
        out = None
        for name in names:
            source = self._dataset(name)
            have = [c for c in wanted if c in source.columns]
            part = rows.where(F.col("dataset") == name).join(source.select("row_index", *have), "row_index", "left").select(*base, *[F.col(c) for c in have])
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
        if out is None:
            out = rows.limit(0)
        return out.withColumns({c: F.lit(None).cast("double") for c in wanted if c not in out.columns}).select(*base, *wanted)

    def full_for(self, uids, datasets: Iterable[str] | None = None) -> DataFrame:
        names = self.index.datasets() if datasets is None else sorted(datasets)
        every = list(dict.fromkeys(c for n in names for c in self._dataset(n).columns))
        return self.partial_for(uids, every, names)

    def iter_partial(self, uids: Iterable[int], columns: list[str], batch_size: int, datasets: Iterable[str] | None = None) -> Iterator[DataFrame]:
        """One lazy DataFrame for each batch of the given uids, in their order.  A range is never listed."""
        if batch_size <= 0:
            raise ValueError("batch_size must be positive")
        asked = uids if isinstance(uids, range) else list(uids)
        for at in range(0, len(asked), batch_size):
            yield self.partial_for(asked[at : at + batch_size], columns, datasets)
