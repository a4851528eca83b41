"""Versioned tables of zone transitions, and wall time to UTC by them."""

from __future__ import annotations

import zoneinfo
from functools import lru_cache

import numpy as np

FIRST_YEAR, LAST_YEAR = 1970, 2050

# North American zone abbreviations, minutes from UTC.
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "GMT": 0, "UT": 0,
    "NST": -210, "NDT": -150, "AST": -240, "ADT": -180, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300,
    "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600, "HDT": -540,
}


def zone_version() -> str:
    """Version of the zone data the tables are made of."""
    try:
        import tzdata

        return tzdata.IANA_VERSION
    except ImportError:
        return "system"


@lru_cache(maxsize=1024)
def transitions(name: str) -> tuple[np.ndarray, np.ndarray] | None:
    """Of a zone: the UTC seconds at which its offset changes, and the offsets before, between and after.

    None for an unknown name. Found by bisection between days, once for each zone and worker.
    """
    import datetime as dt

    try:
        zone = zoneinfo.ZoneInfo(name)
    except (zoneinfo.ZoneInfoNotFoundError, ValueError, OSError):
        return None

    def offset(sec: int) -> int:
        return int(dt.datetime.fromtimestamp(sec, zone).utcoffset().total_seconds())

    start = int(dt.datetime(FIRST_YEAR, 1, 1, tzinfo=dt.UTC).timestamp())
    end = int(dt.datetime(LAST_YEAR, 1, 1, tzinfo=dt.UTC).timestamp())
    step = 86400 * 7
    at, offsets, before = [], [offset(start)], start
    for sec in range(start + step, end + step, step):
        if offset(sec) != offsets[-1]:
            low, high = before, sec
            while high - low > 1:
                mid = (low + high) // 2
                low, high = (mid, high) if offset(mid) == offsets[-1] else (low, mid)
            at.append(high)
            offsets.append(offset(high))
        before = sec
    return np.array(at, dtype=np.int64), np.array(offsets, dtype=np.int64)


# Zones on all continents, both hemispheres: two sets of zone data that agree on them in all years are one.
_WITNESSES = ("America/New_York", "America/Sao_Paulo", "Europe/London", "Africa/Cairo", "Asia/Kolkata", "Australia/Sydney")


@lru_cache(maxsize=1)
def zone_fingerprint() -> str:
    """Version and a hash of the tables of some zones: workers must have the driver's."""
    import hashlib

    digest = hashlib.sha256()
    for name in _WITNESSES:
        found = transitions(name)
        digest.update(b"none" if found is None else found[0].tobytes() + found[1].tobytes())
    return f"{zone_version()}-{digest.hexdigest()[:16]}"


def wall_to_utc(wall: np.ndarray, name: str) -> np.ndarray | None:
    """UTC seconds of wall seconds in a zone; None for an unknown zone.

    A wall time that occurs twice means the first; one that is skipped moves on by the gap. Both
    come from the offset that held before the transition: each transition ends, in wall time, at
    its instant plus the larger of the two offsets, and up to there the earlier offset holds.
    """
    found = transitions(name)
    if found is None:
        return None
    at, offsets = found
    borders = at + np.maximum(offsets[:-1], offsets[1:])
    return wall - offsets[np.searchsorted(borders, wall, side="right")]
