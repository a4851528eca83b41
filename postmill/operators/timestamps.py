"""Mixed timestamp formats and time zones to one UTC instant (problem 4).

A value is reduced to its shape mask: each digit becomes ``9``, each Latin letter ``a``, all else
stays. Values of one mask have their fields at the same offsets, so a mask is compiled once into a
parser that knows where each field lies, and the parser then works on all values of that mask at
once, as matrices of characters. Wall times are turned into instants through transition tables.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions.zones import ABBREVIATIONS, wall_to_utc, zone_fingerprint

# The instants of bare numbers, in seconds: from 2024-01-01 until before 2028-01-01.
NUMBER_FROM, NUMBER_UNTIL = 1_704_067_200, 1_830_297_600
# No form is longer: a weekday, a long month, date, time and offset take under 60 characters, a zone's name under 40.
MAX_LENGTH = 160

_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
_MONTH = {name[:n]: i + 1 for i, name in enumerate(_MONTHS) for n in {3, len(name)}} | {"sept": 9}

_TIME = r"(?P<H>9{1,2}):(?P<M>99)(?::(?P<S>99)(?:[.,](?P<f>9{1,12}))?)?(?: ?(?P<half>aa)(?!a))?"
_BASIC_TIME = r"(?P<H>99)(?P<M>99)(?:(?P<S>99)(?:[.,](?P<f>9{1,12}))?)?"
_ZONE = r"(?: ?(?P<off>[+-]99:?99|[+-]99)| (?P<zone>a{1,4}|a+(?:/a+(?:_a+)*)+)|(?P<z>a))?"
_DATES = (
    r"(?P<Y>9{4})(?P<sep>[-/.])(?P<m>9{1,2})(?P=sep)(?P<d>9{1,2})",
    r"(?P<Y>9{4})-(?P<yday>999)",
    r"(?P<one>9{1,2})(?P<sep>[-/.])(?P<two>9{1,2})(?P=sep)(?P<Y>9{4})",
    r"(?:aaa, )?(?P<d>9{1,2})[ -](?P<month>a{3,9})[ -](?P<Y>9{4})",
    r"(?:aaa, )?(?P<month>a{3,9})\.? (?P<d>9{1,2}),? (?P<Y>9{4})",
)
_FORMS = [re.compile(rf"{date}(?:(?P<T>a|,? ){_TIME}{_ZONE})?\Z") for date in _DATES] + [
    re.compile(rf"(?P<Y>9{{4}})(?P<m>99)(?P<d>99)(?P<T>a){_BASIC_TIME}{_ZONE}\Z"),
    re.compile(r"(?P<number>9{1,20})(?:\.(?P<f>9{1,12}))?\Z"),
]


@lru_cache(maxsize=4096)
def _parser(mask: str) -> dict[str, slice] | None:
    """Where the fields of a mask lie; None where it is no known form. Once for each distinct mask."""
    for form in _FORMS:
        if m := form.match(mask):
            return {k: slice(*m.span(k)) for k in m.groupdict() if m.span(k)[0] >= 0}
    return None


def _days(y: np.ndarray, m: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Days from 1970-01-01 of dates in the Gregorian calendar."""
    months = (y - 1970) * 12 + m - 1
    return months.astype("datetime64[M]").astype("datetime64[D]").astype(np.int64) + d - 1


def _month_length(y: np.ndarray, m: np.ndarray) -> np.ndarray:
    one = np.ones_like(y)
    return _days(y + m // 12, m % 12 + 1, one) - _days(y, m, one)


def _by_word(words: np.ndarray, known) -> np.ndarray:
    """``known(word)`` for each word, worked out once for each distinct word."""
    distinct, back = np.unique(words, return_inverse=True)
    return np.array([known(str(w)) for w in distinct])[back]


def _instants(values: np.ndarray, mask: str, zones: np.ndarray, styles: np.ndarray) -> np.ndarray | None:
    """Microseconds of values of one mask; the smallest int64 where a value names no instant."""
    at = _parser(mask)
    if at is None:
        return None
    none = np.iinfo(np.int64).min
    n, width = len(values), len(mask)
    chars = values.astype(f"U{width}").view("U1").reshape(n, width)
    digits = chars.view(np.uint32).reshape(n, width).astype(np.int64) - 48

    def number(k: str, default: int = 0) -> np.ndarray:
        if k not in at:
            return np.full(n, default, dtype=np.int64)
        part = digits[:, at[k]]
        return part @ (10 ** np.arange(part.shape[1] - 1, -1, -1, dtype=np.int64))

    def word(k: str) -> np.ndarray:
        part = np.ascontiguousarray(chars[:, at[k]])
        return part.view(f"U{part.shape[1]}").reshape(n)

    micros = np.zeros(n, dtype=np.int64)
    if "f" in at:  # digits finer than a microsecond are cut off
        part = digits[:, at["f"]][:, :6]
        micros = part @ (10 ** np.arange(5, 5 - part.shape[1], -1, dtype=np.int64))
    if "number" in at:
        length = at["number"].stop - at["number"].start
        if length > 19:
            return None
        if length == 19 and (digits[:, 0] > 8).any():
            digits[digits[:, 0] > 8, :] = 0
        v, out = number("number"), np.full(n, none, dtype=np.int64)
        for scale in (1, 10**3, 10**6, 10**9):
            fits = (v >= NUMBER_FROM * scale) & (v < NUMBER_UNTIL * scale)
            us = v * (10**6 // scale) if scale <= 10**6 else v // (scale // 10**6)
            out = np.where(fits, us + (micros if scale == 1 else 0), out)
        return out

    y, ok = number("Y"), np.ones(n, dtype=bool)
    if "yday" in at:
        days = number("yday")
        ok &= (days >= 1) & (days <= 365 + ((y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))))
        days += _days(y, np.ones_like(y), np.zeros_like(y))
    else:
        if "one" in at:
            one, two = number("one"), number("two")
            day_first = styles == "dmy"
            m, d = np.where(day_first, two, one), np.where(day_first, one, two)
        else:
            m = _by_word(word("month"), lambda w: _MONTH.get(w.lower(), 0)) if "month" in at else number("m")
            d = number("d")
        ok &= (m >= 1) & (m <= 12) & (y >= 1)
        m = np.where(ok, m, 1)
        ok &= (d >= 1) & (d <= _month_length(y, m))
        days = _days(y, m, d)
    hour, minute, second = number("H"), number("M"), number("S")
    if "half" in at:
        half = _by_word(word("half"), lambda w: {"am": 0, "pm": 12}.get(w.lower(), -1))
        ok &= (half >= 0) & (hour >= 1) & (hour <= 12)
        hour = hour % 12 + half
    if "T" in at and at["T"].stop - at["T"].start == 1 and mask[at["T"]] == "a":
        ok &= _by_word(word("T"), lambda w: w in "Tt")
    ok &= (hour <= 23) & (minute <= 59) & (second <= 59)
    wall = days * 86400 + hour * 3600 + minute * 60 + second
    if "off" in at:
        text = word("off")
        off = _by_word(text, lambda w: int(w[0] + "1") * (int(w[1:3]) * 60 + (int(w[-2:]) if len(w) > 3 else 0)))
        sec = wall - off * 60
    else:
        names = zones
        fixed = np.zeros(n, dtype=bool)
        if "zone" in at or "z" in at:
            names = word("zone" if "zone" in at else "z")
            minutes = _by_word(names, lambda w: ABBREVIATIONS.get(w.upper(), 10**6) if "/" not in w else 10**6)
            fixed = minutes < 10**6
            ok &= fixed | ("/" in mask)
            sec = wall - np.where(fixed, minutes, 0) * 60
        else:
            sec = wall.copy()
        rest = ok & ~fixed
        for name in np.unique(names[rest]):
            here = rest & (names == name)
            utc = wall_to_utc(wall[here], str(name))
            if utc is None:
                ok &= ~here
            else:
                sec[here] = utc
    return np.where(ok, sec * 10**6 + micros, none)


def _normalise(batches: Iterator[pd.DataFrame], zones: str) -> Iterator[pd.DataFrame]:
    if zone_fingerprint() != zones:
        raise RuntimeError(f"this worker's zone data are {zone_fingerprint()}, the driver's {zones}")
    for pdf in batches:
        out = pd.Series(pd.array([pd.NA] * len(pdf), dtype="Int64"))
        none = np.iinfo(np.int64).min
        for mask, rows in pdf.groupby("__mask", sort=False).indices.items():
            part = pdf.iloc[rows]
            got = _instants(
                part["__value"].to_numpy(dtype=object).astype(str),
                mask,
                part["__zone"].to_numpy(dtype=object).astype(str),
                part["__style"].to_numpy(dtype=object).astype(str),
            )
            if got is not None:
                out.iloc[rows] = pd.array(np.where(got == none, 0, got), dtype="Int64")
                out.iloc[rows[got == none]] = pd.NA
        keep = pdf.drop(columns=["__value", "__mask", "__zone", "__style"])
        keep["epoch_us"] = out.to_numpy()
        yield keep[out.notna().to_numpy()]


def _clean(value: Column) -> Column:
    """Outer white space off, whatever kind of space it is."""
    return F.regexp_replace(value, r"^[\s\p{Z}\x{FEFF}]+|[\s\p{Z}\x{FEFF}]+\z", "")


def text_instants(df: DataFrame, keys: list[str], value: str, zone: Column | str, style: Column | str, version: str | None = None) -> DataFrame:
    """``keys`` and ``epoch_us`` of each row whose text ``value`` names an instant.

    ``zone`` is the zone of values that bear none (null: UTC); ``style`` is ``dmy``, ``mdy`` or
    ``ymd`` and orders a numeric day and month behind which the year stands (``ymd`` and null: month
    first). Defined results: null, empty, blank and over-long values, placeholders, impossible dates
    or times, unknown zones and unknown shapes give no row; repeated rows give repeated rows. All workers must have the
    driver's zone data, else the query fails; ``version`` names a column that says which these were.
    """
    col = lambda c: F.col(c) if isinstance(c, str) else c
    text = _clean(F.col(value))
    mask = F.translate(F.col("__value"), "0123456789" + _LETTERS, "9" * 10 + "a" * len(_LETTERS))
    rows = (
        df.select(*keys, text.alias("__value"), F.coalesce(col(zone), F.lit("UTC")).alias("__zone"), F.coalesce(col(style), F.lit("ymd")).alias("__style"))
        .where(F.col("__value").isNotNull() & F.length("__value").between(1, MAX_LENGTH) & F.col("__value").rlike("[0-9]"))
        .withColumn("__mask", mask)
    )
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema)
    zones = zone_fingerprint()
    out = rows.mapInPandas(lambda batches: _normalise(batches, zones), f"{types}, epoch_us bigint")
    return out.withColumn(version, F.lit(zones)) if version else out


def number_instant(value: Column) -> Column:
    """Microseconds of an integer that counts from 1970 in s, ms, us or ns by its size; else null."""
    v = value.cast("bigint")
    within = lambda scale: v.between(NUMBER_FROM * scale, NUMBER_UNTIL * scale - 1)
    return (
        F.when(within(1), v * 10**6)
        .when(within(10**3), v * 10**3)
        .when(within(10**6), v)
        .when(within(10**9), F.call_function("div", v, F.lit(1000)))
    )
