"""A tree of datasets: discovery, versions, and the identity and link tables kept beside them."""

from __future__ import annotations

import configparser
import json
import logging
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.identity import IdentityIndex, IdentityQuery
from ..operators.links import LinkRules, LinkSet, first_rows, link
from ..operators.match import MatchResult, MatchRules, cross_match, legacy_rules
from . import ingest, loaders
from .manifest import NAME, Manifest, ManifestError, has_manifest, read_manifest, write_atomic
from .scan import ROW_INDEX, DatasetView
from .schema import Geometry
from .validity import Validity, instant, now_utc

log = logging.getLogger(__name__)
IDENTITY, LINKS = "_identity", "_links"


@dataclass(frozen=True)
class Entry:
    name: str
    path: Path
    manifest: Manifest


def name_of(relative: Path) -> tuple[str, str]:
    """(name, survey type) of a dataset from its path below the root."""
    parts = [p.lower() for p in relative.parts]
    return "_".join(parts) or "dataset", parts[0] if parts else "unknown"


def discover(root: Path, max_depth: int = 6) -> Iterator[tuple[Path, Manifest]]:
    """Readable manifests in the order of their paths; unreadable ones are reported and passed over.  A dataset's own
    folders are not entered, nor anything below max_depth."""
    folders = [root]
    while folders:
        folder = folders.pop()
        if has_manifest(folder):
            try:
                yield folder, read_manifest(folder)
            except ManifestError as e:
                log.warning("skipped: %s", e)
            continue
        if folder.is_dir() and len(folder.relative_to(root).parts) < max_depth:
            below = sorted((p for p in folder.iterdir() if p.is_dir() and p.name not in (IDENTITY, LINKS)), reverse=True)
            folders += below


def supersede(entries: dict[str, Entry]) -> dict[str, Entry]:
    """An open version that a later one supersedes ends where that one begins, in memory only."""
    out = dict(entries)
    for e in entries.values():
        v = e.manifest.validity
        prior = out.get(v.supersedes) if v and v.supersedes else None
        if prior is None or prior.manifest.validity is None or not prior.manifest.validity.open:
            continue
        if instant(v.valid_from_utc) <= instant(prior.manifest.validity.valid_from_utc):
            log.warning("%s does not begin after %s, which stays open", e.name, prior.name)
            continue
        out[prior.name] = replace(prior, manifest=replace(prior.manifest, validity=prior.manifest.validity.closed_at(v.valid_from_utc)))
    return out


def overlapping(entries: dict[str, Entry]) -> list[tuple[str, str]]:
    """Neighbours on disk that are valid at one time, although neither names the other."""
    found = []
    rows = sorted(entries.values(), key=lambda e: e.name)
    for i, a in enumerate(rows):
        for b in rows[i + 1 :]:
            va, vb = a.manifest.validity, b.manifest.validity
            if a.path.parent == b.path.parent and va and vb and a.name != vb.supersedes and b.name != va.supersedes and va.overlaps(vb):
                found.append((a.name, b.name))
    return found


class Database:
    """entries: name -> Entry of what is valid now; every: all versions found."""

    def __init__(self, spark: SparkSession, root: str | Path, name_from_path: Callable[[Path], tuple[str, str]] = name_of, max_depth: int = 6, as_of: str | datetime | None = None):
        self.spark, self.root = spark, Path(root)
        self.options = {"name_from_path": name_from_path, "max_depth": max_depth}
        found = {}
        for path, manifest in discover(self.root, max_depth):
            name = name_from_path(path.relative_to(self.root))[0]
            found[name] = Entry(name, path, manifest)
        self.every = supersede(found)
        for a, b in overlapping(self.every):
            log.warning("%s and %s are valid at the same time", a, b)
        when = as_of or now_utc()
        holds = lambda v: v is not None and v.contains(when) if as_of else v is None or v.contains(when)
        self.entries = {n: e for n, e in self.every.items() if holds(e.manifest.validity)}
        self.moment = as_of

    def as_of(self, when: str | datetime) -> "Database":
        """The datasets valid at an instant; those without validity are left out."""
        return Database(self.spark, self.root, as_of=instant(when), **self.options)

    def versions_of_root(self, path: str | Path) -> list[Entry]:
        base = self.root / path
        rows = [e for e in self.every.values() if base == e.path or base in e.path.parents]
        return sorted(rows, key=lambda e: (e.manifest.validity is not None, e.manifest.validity and instant(e.manifest.validity.valid_from_utc), e.name))

    def list(self, survey_type: str | None = None) -> list[str]:
        return sorted(n for n, e in self.entries.items() if survey_type in (None, e.manifest.survey_type))

    @property
    def types(self) -> list[str]:
        return sorted({e.manifest.survey_type for e in self.entries.values()})

    def entry(self, name: str) -> Entry:
        if name not in self.entries:
            raise KeyError(f"{name}; there are {sorted(self.entries)}")
        return self.entries[name]

    def view(self, name: str) -> DatasetView:
        e = self.entry(name)
        return DatasetView(self.spark, e.path, e.manifest)

    __getitem__ = view

    def __len__(self) -> int:
        return len(self.entries)

    def __contains__(self, name: str) -> bool:
        return name in self.entries

    def __iter__(self) -> Iterator[str]:
        return iter(self.list())

    def load(self, name: str, **options) -> DataFrame:
        return self.view(name).scan(**options)

    def get_loader(self, name: str) -> loaders.SurveyLoader:
        """A loader of a dataset, made from its manifest: load() selects rows and columns as a survey's own loader does."""
        e = self.entry(name)
        kind = type(f"{name.title().replace('_', '')}Dataset", (loaders.SurveyLoader,), {"config": loaders.SurveyConfig(name, e.manifest.survey_type, (), "parquet", e.manifest.n_rows, f"dataset {name}", fields={c: c for c in e.manifest.schema.names}), "_place": lambda self, path, own=e.path: own})
        return kind(self.spark)

    from_config = staticmethod(lambda spark, path: from_config(spark, path))

    @classmethod
    def from_root(cls, spark: SparkSession, root: str | Path, **options) -> "Database":
        return cls(spark, root, **options)

    def register_views(self) -> None:
        """Every dataset as a temporary view, for SQL."""
        for name in self:
            self.load(name).createOrReplaceTempView(name)

    def summary(self) -> DataFrame:
        """From manifests alone: name, survey_type, geometry, n_rows, n_partitions."""
        rows = [(n, e.manifest.survey_type, e.manifest.geometry.value, e.manifest.n_rows, e.manifest.n_partitions) for n, e in sorted(self.entries.items())]
        return self.spark.createDataFrame(rows, "name string, survey_type string, geometry string, n_rows long, n_partitions int")

    def positions(self, name: str) -> DataFrame:
        """row_index, ra, dec, z, z_type of a dataset; of light curves and sightlines, of their objects."""
        view = self.view(name)
        if view.geometry is Geometry.HEALPIX:
            raise ValueError(f"{name} is a map and has no objects")
        if view.geometry is Geometry.POINT:
            rows = view.scan().withColumn("row_index", F.col(ROW_INDEX))
        else:
            key = "object_id" if view.geometry is Geometry.LIGHTCURVE else "sightline_id"
            rows = view.objects().withColumn("row_index", F.col(key)).withColumnsRenamed({"z_source": "z"})
        return rows.select("row_index", "ra", "dec", *[c for c in ("z", "z_type") if c in rows.columns])

    def _attributes(self, name: str) -> DataFrame:
        """What identities are hydrated from: the rows of points, the objects of light curves and sightlines."""
        view = self.view(name)
        if view.geometry is Geometry.POINT:
            return view.scan().withColumn("row_index", F.col(ROW_INDEX))
        return view.objects().withColumn("row_index", F.col("object_id" if view.geometry is Geometry.LIGHTCURVE else "sightline_id"))

    def build_identity(self, datasets: list[str] | None = None, rules: MatchRules | None = None, name: str = "default", persist: bool = True, **legacy) -> IdentityIndex:
        """Cross-match point datasets (others by name only).  Unknown names raise, unreadable datasets are passed over.

        legacy: sky_tol_arcsec and dz_tol in place of rules; with either of them dz_tol (None: no limit) is the default's.
        """
        rules = legacy_rules(rules, **legacy)
        chosen = datasets or [n for n in self if self.entry(n).manifest.geometry is Geometry.POINT]
        frames = {}
        for n in chosen:
            self.entry(n)
            try:
                frames[n] = self.positions(n)
            except (ValueError, OSError) as e:
                log.warning("%s is left out: %s", n, e)
        kinds = {n: self.entry(n).manifest.survey_type for n in frames}
        rows = cross_match(frames, rules).rows
        kind = F.create_map(*[F.lit(x) for k, v in kinds.items() for x in (k, v)]) if kinds else None
        rows = rows.withColumn("survey_type", kind[F.col("dataset")] if kind is not None else F.lit(None).cast("string"))
        index = IdentityIndex(rows, rules, name, Validity(now_utc()))
        return self._save(IDENTITY, name, rows.orderBy("uid", "dataset", "row_index"), {"rules": rules.state(), "rules_hash": rules.hash, "datasets": sorted(frames)}, lambda r, d: self._index(r, d, name)) if persist else index

    def _index(self, rows: DataFrame, state: dict, name: str) -> IdentityIndex:
        return IdentityIndex(rows, MatchRules.from_state(state["rules"]), name, Validity(**state["validity"]), tuple(state.get("datasets", ())) or None, tuple(state["counts"]) if state.get("counts") else None)

    def _save(self, kind: str, name: str, rows: DataFrame, state: dict, wrap):
        """Data under a fresh folder, then the pointer file; what was live before stays as an archive that ends now."""
        if "__" in name:
            raise ValueError("names must not contain two underscores in a row")
        folder = self.root / kind
        moment = datetime.now(timezone.utc)
        stamp = moment.strftime("%Y%m%dT%H%M%S%f")
        data = folder / f"{name}-{stamp}.parquet"
        rows.write.option("compression", "zstd").parquet(str(data))
        if kind == IDENTITY:
            counts = MatchResult(self.spark.read.parquet(str(data)), MatchRules()).counts()
            state = state | {"counts": [counts["n_unique"], counts["n_multi"]]}
        live = folder / f"{name}.json"
        if live.exists():
            old = json.loads(live.read_text())
            old["validity"]["valid_to_utc"] = moment.isoformat()
            write_atomic(folder / f"{name}__{stamp}.json", json.dumps(old, indent=1))
        full = state | {"format_version": 1, "data": data.name, "validity": Validity(moment.isoformat()).to_dict()}
        write_atomic(live, json.dumps(full, indent=1))
        return wrap(self.spark.read.parquet(str(data)), full)

    def _find(self, kind: str, name: str, as_of: str | datetime | None) -> dict:
        folder = self.root / kind
        moment = as_of or self.moment
        for path in [folder / f"{name}.json", *sorted(folder.glob(f"{name}__*.json"))]:
            if path.exists():
                state = json.loads(path.read_text())
                if state.get("format_version") != 1:
                    raise ManifestError(f"{path}: format {state.get('format_version')} cannot be read")
                if moment is None or Validity(**state["validity"]).contains(moment):
                    return state
        raise FileNotFoundError(f"no {name!r} in {folder}" + (f" as of {moment}" if moment else ""))

    def _names(self, kind: str, archived: bool) -> list[str]:
        return sorted(p.stem for p in (self.root / kind).glob("*.json") if archived or "__" not in p.stem)

    def load_identity(self, name: str = "default", as_of: str | datetime | None = None) -> IdentityIndex:
        state = self._find(IDENTITY, name, as_of)
        return self._index(self.spark.read.parquet(str(self.root / IDENTITY / state["data"])), state, name)

    def list_identities(self, include_archived: bool = False) -> list[str]:
        return self._names(IDENTITY, include_archived)

    def identity_query(self, name: str = "default", as_of=None) -> IdentityQuery:
        return IdentityQuery(self.load_identity(name, as_of), self._attributes)

    def build_links(self, rules: LinkRules, parents: list[str] | None = None, children: list[str] | None = None, name: str = "default", identity: str = "default", across_datasets: bool = False) -> LinkSet:
        """Links of children to parents; without names, all datasets that the identities hold of the rules' survey types."""
        index = self.load_identity(identity)
        held = [n for n in index.datasets() if n in self]
        of_type = lambda kind: [n for n in held if self.entry(n).manifest.survey_type == kind]
        parents = of_type(rules.parent_survey_type) if parents is None else parents
        children = of_type(rules.child_survey_type) if children is None else children
        for names, kind in ((parents, rules.parent_survey_type), (children, rules.child_survey_type)):
            for n in names:
                if self.entry(n).manifest.survey_type != kind:
                    raise ValueError(f"{n} is of type {self.entry(n).manifest.survey_type}, not {kind}")
        rows = link(first_rows(index.rows, parents), first_rows(index.rows, children), rules, across_datasets)
        return self._save(LINKS, name, rows, {"rules": rules.state(), "rules_hash": rules.hash, "identity_hash": index.rules.hash}, lambda r, d: self._link_set(r, d, name))

    def _link_set(self, rows: DataFrame, state: dict, name: str) -> LinkSet:
        return LinkSet(rows, LinkRules(**state["rules"]), name, Validity(**state["validity"]), state["identity_hash"])

    def load_links(self, name: str = "default", as_of: str | datetime | None = None) -> LinkSet:
        state = self._find(LINKS, name, as_of)
        return self._link_set(self.spark.read.parquet(str(self.root / LINKS / state["data"])), state, name)

    def list_link_sets(self, include_archived: bool = False) -> list[str]:
        return self._names(LINKS, include_archived)

    load_oneuid, list_oneuids = load_identity, list_identities
    load_subobject_links, list_subobject_link_sets = load_links, list_link_sets

    def __repr__(self) -> str:
        return f"Database({str(self.root)!r}, {len(self)} datasets)"


def convert(spark: SparkSession, survey: str, out: str | Path, raw_path: str | None = None, overwrite: bool = False, rows_per_file: int | None = None, compression: str = "zstd", validity: Validity | None = None, **options) -> Manifest:
    """Read a registered survey's raw file and write it as a dataset."""
    loader = loaders.get_loader(survey)(spark)
    rows = loader.load(validate=False, path=raw_path, force_native=True, **options)
    originals = ()
    if raw_path and Path(raw_path).is_file():
        found = ingest.hashes(spark, [str(raw_path)]).first()
        originals = ({"path": str(raw_path), "format": loader.config.data_format, "sha256": found["sha256"], "size": found["size"], "rows": ingest.source_rows(spark, str(raw_path), loader.config.data_format) if loader.config.data_format in ("fits", "csv") else None},)
    elif raw_path:
        originals = ({"path": str(raw_path), "format": loader.config.data_format},)
    return ingest.write_dataset(ingest.standard_columns(rows), out, survey, loader.config.survey_type, overwrite=overwrite, rows_per_file=rows_per_file, compression=compression, validity=validity, original_files=originals, conversion_kwargs={k: str(v) for k, v in options.items()}, loader={"name": survey})


def build(spark: SparkSession, raw_root: str | Path, root: str | Path, overwrite: bool = False, skip_existing: bool = True) -> dict[str, str]:
    """Convert every registered survey whose raw file is there; per survey: done, kept, absent or the error."""
    out = {}
    for name in loaders.list_surveys():
        config = loaders.survey_config(name)
        raw, target = Path(raw_root) / config.subpath / (config.file_name or f"{name}.{config.data_format}"), Path(root) / config.subpath
        if not raw.exists():
            out[name] = "absent"
        elif (target / NAME).exists() and skip_existing and not overwrite:
            out[name] = "kept"
        else:
            try:
                convert(spark, name, target, str(raw), overwrite=True)
                out[name] = "done"
            except Exception as e:  # one survey's failure does not stop the others
                log.warning("%s: %s", name, e)
                out[name] = f"failed: {e}"
    return out


def coerced(text: str) -> bool | None | int | float | str:
    low = text.strip().lower()
    if low in ("true", "yes", "on", "false", "no", "off"):
        return low in ("true", "yes", "on")
    if low in ("none", "null", ""):
        return None
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text.strip()


def parse_config(path: str | Path) -> tuple[dict, list[dict]]:
    """An INI file: [database] root, overwrite; [dataset x] loader, raw_path, output_subpath, skip and loader options."""
    ini = configparser.ConfigParser()
    with open(path) as f:
        ini.read_file(f)
    if "database" not in ini or "root" not in ini["database"]:
        raise ValueError("the configuration needs [database] with a root")
    base = {k: coerced(v) for k, v in ini["database"].items()}
    sets = []
    for section in ini.sections():
        if section.startswith("dataset "):
            own = {k: coerced(v) for k, v in ini[section].items()}
            known = {k: own.pop(k, None) for k in ("loader", "raw_path", "output_subpath", "skip")}
            sets.append({"name": section.split(None, 1)[1], **known, "options": own})
    return base, sets


def from_config(spark: SparkSession, path: str | Path) -> tuple[Database, dict[str, str]]:
    """Convert what the file names; failures are told, not raised.  Then open the database."""
    base, sets = parse_config(path)
    root, told = Path(base["root"]), {}
    root.mkdir(parents=True, exist_ok=True)
    for s in sets:
        if s["skip"]:
            told[s["name"]] = "skipped"
            continue
        try:
            survey = s["loader"] or s["name"]
            target = root / (s["output_subpath"] or loaders.survey_config(survey).subpath)
            if (target / NAME).exists() and not base.get("overwrite"):
                told[s["name"]] = "kept"
                continue
            convert(spark, survey, target, s["raw_path"], overwrite=True, **s["options"])
            told[s["name"]] = "done"
        except Exception as e:
            log.warning("%s: %s", s["name"], e)
            told[s["name"]] = f"failed: {e}"
    return Database(spark, root), told
