"""The JSON description of a dataset: written last, read on the driver, trusted over the directory's content."""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from dataclasses import asdict, dataclass, field
from pathlib import Path

from pyspark.sql import types as T

from .schema import Geometry
from .validity import Temporal, Validity, now_utc

VERSION = 1
NAME = "manifest.json"


class ManifestError(ValueError):
    pass


@dataclass(frozen=True)
class DataFile:
    """One Parquet file.  ranges: {"ra": [low, high], ...} of ra, dec, z, t; a missing one never prunes."""

    path: str
    rows: int
    cell: int | None = None
    ranges: dict = field(default_factory=dict)
    size: int = 0
    sha256: str = ""


def _united(a: list, b: list) -> list:
    """The range of both; a file without a finite value has [None, None]."""
    if None in a or None in b:
        return list(b if None in a else a)
    return [min(a[0], b[0]), max(a[1], b[1])]


@dataclass(frozen=True)
class Manifest:
    """schema: Spark's own description of the data's columns.  layout: how rows are dealt to files.  sources: the raw
    files.  made_by: loader and its options.  notes: what a geometry needs besides."""

    survey_name: str
    survey_type: str
    geometry: Geometry
    files: tuple[DataFile, ...]
    schema: T.StructType = field(default_factory=T.StructType)
    layout: dict = field(default_factory=dict)
    observed: Temporal | None = None
    validity: Validity | None = None
    sources: tuple[dict, ...] = ()
    made_by: dict = field(default_factory=dict)
    notes: dict = field(default_factory=dict)
    written: str = field(default_factory=now_utc)

    @property
    def n_rows(self) -> int:
        return sum(f.rows for f in self.files)

    @property
    def n_partitions(self) -> int:
        return len(self.files)

    @property
    def nside(self) -> int | None:
        return self.layout.get("nside")

    @property
    def temporal(self) -> Temporal | None:
        return self.observed

    def cells(self) -> list[DataFile]:
        """Rows and ranges of every cell, over all its files; a crowded cell has several.  Without cells: of every file."""
        out: dict = {}
        for f in self.files:
            key = f.path if f.cell is None else f.cell
            if key not in out:
                out[key] = DataFile(f.path, f.rows, f.cell, f.ranges, f.size)
                continue
            had = out[key]
            ranges = {n: _united(had.ranges[n], f.ranges[n]) for n in had.ranges if n in f.ranges}
            out[key] = DataFile(str(Path(f.path).parent), had.rows + f.rows, f.cell, ranges, had.size + f.size)
        return list(out.values())

    def state(self) -> dict:
        return {
            "astrolane_manifest": VERSION,
            "survey": {"name": self.survey_name, "type": self.survey_type},
            "geometry": self.geometry.value,
            "written": self.written,
            "valid": self.validity and self.validity.to_dict(),
            "observed": self.observed and self.observed.to_dict(),
            "layout": self.layout,
            "schema": self.schema.jsonValue(),
            "files": [asdict(f) for f in self.files],
            "sources": list(self.sources),
            "made_by": self.made_by,
            "notes": self.notes,
        }

    @classmethod
    def of(cls, state: dict) -> "Manifest":
        """From state(); without validity a dataset is valid from the time it was written."""
        if state.get("astrolane_manifest") != VERSION:
            raise ValueError(f"version {state.get('astrolane_manifest')} cannot be read")
        valid, observed = state["valid"] or {"valid_from_utc": state["written"]}, state["observed"]
        return cls(
            state["survey"]["name"], state["survey"]["type"], Geometry(state["geometry"]), tuple(DataFile(**f) for f in state["files"]), T.StructType.fromJson(state["schema"]), state["layout"],
            Temporal(**observed) if observed else None, Validity(**valid), tuple(state["sources"]), state["made_by"], state["notes"], state["written"],
        )


def hash_bytes(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()[:16]


def hash_file(path: str | Path) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while chunk := f.read(1 << 20):
            h.update(chunk)
    return h.hexdigest()[:16]


def write_atomic(path: str | Path, data: str | bytes) -> None:
    """Readers see the old content or all of the new one."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    part = path.with_name(f".{path.name}.{uuid.uuid4().hex}.tmp")
    try:
        with open(part, "wb") as f:
            f.write(data.encode() if isinstance(data, str) else data)
            f.flush()
            os.fsync(f.fileno())
        os.replace(part, path)
    finally:
        part.unlink(missing_ok=True)


def write_manifest(folder: str | Path, manifest: Manifest) -> None:
    write_atomic(Path(folder) / NAME, json.dumps(manifest.state(), indent=1))


def read_manifest(folder: str | Path) -> Manifest:
    try:
        return Manifest.of(json.loads((Path(folder) / NAME).read_text()))
    except (OSError, ValueError, TypeError, KeyError, AttributeError) as e:
        raise ManifestError(f"{folder}: {type(e).__name__} {e}") from e


def has_manifest(folder: str | Path) -> bool:
    """Whether a folder holds a finished dataset."""
    return (Path(folder) / NAME).is_file()
