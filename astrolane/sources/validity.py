"""Two time axes: when a dataset's description was current (UTC instants), and when its objects were observed (MJD)."""

from __future__ import annotations

from dataclasses import asdict, dataclass
from datetime import datetime, timezone

TIME_REFERENCES = ("TDB", "TAI", "UTC", "TT")


def instant(text: str | datetime) -> datetime:
    """An instant with a time zone; a time without one is rejected."""
    when = datetime.fromisoformat(text.replace("Z", "+00:00")) if isinstance(text, str) else text
    if when.tzinfo is None:
        raise ValueError(f"{text} has no time zone")
    return when.astimezone(timezone.utc)


def now_utc() -> str:
    return datetime.now(timezone.utc).isoformat()


@dataclass(frozen=True)
class Validity:
    """Half open: from valid_from_utc up to, not including, valid_to_utc (None: until further notice)."""

    valid_from_utc: str
    valid_to_utc: str | None = None
    version: str | None = None
    supersedes: str | None = None

    def __post_init__(self):
        start = instant(self.valid_from_utc)
        if self.valid_to_utc is not None and instant(self.valid_to_utc) <= start:
            raise ValueError("valid_to_utc must be after valid_from_utc")

    def contains(self, when: str | datetime) -> bool:
        t = instant(when)
        return instant(self.valid_from_utc) <= t and (self.valid_to_utc is None or t < instant(self.valid_to_utc))

    @property
    def open(self) -> bool:
        return self.valid_to_utc is None

    def closed_at(self, when: str) -> "Validity":
        return Validity(self.valid_from_utc, instant(when).isoformat(), self.version, self.supersedes)

    def overlaps(self, other: "Validity") -> bool:
        before = lambda a, b: a.valid_to_utc is not None and instant(a.valid_to_utc) <= instant(b.valid_from_utc)
        return not before(self, other) and not before(other, self)

    def to_dict(self) -> dict:
        return asdict(self)


@dataclass(frozen=True)
class Temporal:
    """Range and column of the observation time."""

    t_min: float
    t_max: float
    time_column: str = "t_obs"
    time_unit: str = "MJD"
    time_reference: str = "TDB"
    cadence: str | None = None

    def __post_init__(self):
        if self.t_max < self.t_min:
            raise ValueError("t_max is before t_min")
        if self.time_reference not in TIME_REFERENCES:
            raise ValueError(f"unknown time reference {self.time_reference!r}")

    def to_dict(self) -> dict:
        return asdict(self)
