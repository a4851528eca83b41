"""Search parameters, compiled into one Column predicate."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.schema import clean



@dataclass(frozen=True)
class SearchParams:
    """One search: active rows, text, allowed values by column, overlaps by array column, window, newness, order, paging."""

    text: str = ""
    text_columns: tuple[str, ...] = ()
    values: dict[str, tuple] = field(default_factory=dict)
    overlaps: dict[str, tuple] = field(default_factory=dict)
    window: tuple[str, str, int] | None = None
    since: tuple[str, str] | None = None
    active: str = ""
    sort: str = "seen"
    page: int = 1
    per: int = 50


SORTS = ("seen", "published", "company", "deadline", "score")


def parse_params(
    raw: dict[str, str],
    allowed: dict[str, list[str]],
    per_range: tuple[int, int, int] = (10, 200, 50),
    codes: dict[str, str] | None = None,
    year: tuple[str, str, str] | None = None,
    years: tuple[int, int] = (2020, 2040),
) -> SearchParams:
    """Parameters of a request: unknown values dropped, page at least 1, page size clamped, junk to defaults.

    ``codes`` maps parameters to array columns (a country, a state): their values are put in capitals.
    ``year`` names the parameter of a class year and the columns of the window it must lie in.
    """

    def number(name: str, default: int) -> int:
        text = raw.get(name, "")
        return int(text) if text.lstrip("-").isdigit() else default

    values = {k: tuple(v for v in raw.get(k, "").split(",") if v in ok) for k, ok in allowed.items()}
    low, high, default = per_range
    areas = {column: tuple(v.strip().upper() for v in raw.get(k, "").split(",") if v.strip()) for k, column in (codes or {}).items()}
    stated = number(year[0], 0) if year else 0
    return SearchParams(
        overlaps={k: v for k, v in areas.items() if v},
        window=(year[1], year[2], stated) if year and years[0] <= stated <= years[1] else None,
        sort=raw.get("sort") if raw.get("sort") in SORTS else "seen",
        text=raw.get("q", "").strip(),
        values={k: v for k, v in values.items() if v},
        page=max(1, number("page", 1)),
        per=min(high, max(low, number("per", default))),
    )


def contains_any(columns: tuple[str, ...], text: str) -> Column:
    """Literal substring in any column, case apart; wildcards mean themselves."""
    needle = F.lit(text.lower())
    return reduce(lambda a, b: a | b, [F.coalesce(F.contains(F.lower(F.col(c)), needle), F.lit(False)) for c in columns])


def in_or_none(column: str, values: tuple, none: str = "none") -> Column:
    """Value in a list, where ``none`` stands for null."""
    real = [v for v in values if v != none]
    hit = F.coalesce(F.col(column).isin(real), F.lit(False)) if real else F.lit(False)
    return hit | F.col(column).isNull() if none in values else hit


def overlaps(column: str, values: tuple) -> Column:
    """Whether an array has one of the values; null arrays and null elements never do."""
    return F.coalesce(F.arrays_overlap(F.filter(F.col(column), lambda x: x.isNotNull()), F.array(*[F.lit(v) for v in values])), F.lit(False))


def keeps_null_in(column: str, values: list) -> Column:
    """In the list, or not stated."""
    return F.col(column).isNull() | F.col(column).isin(values)


def keeps_null_not_in(column: str, values: list) -> Column:
    return F.col(column).isNull() | ~F.col(column).isin(values)


def window_holds(low: str, high: str, value) -> Column:
    """``value`` within a window whose ends may be open (null)."""
    v = F.lit(value)
    return (F.col(low).isNull() | (F.col(low) <= v)) & (F.col(high).isNull() | (F.col(high) >= v))


def windows_overlap(low: str, high: str, first, last) -> Column:
    return (F.col(low).isNull() | (F.col(low) <= F.lit(last))) & (F.col(high).isNull() | (F.col(high) >= F.lit(first)))


def location_allowed(areas: list[tuple[str, tuple]], remote: Column, remote_ok: bool, remote_in: tuple[str, tuple] | None = None) -> Column:
    """Any area overlaps; or nothing is resolved in any; or it is remote and that will do.

    With ``remote_in`` a remote row must have no value in that column, or one of the given ones, if any are given.
    """
    unresolved = reduce(lambda a, b: a & b, [F.coalesce(F.size(c), F.lit(0)) <= 0 for c, _ in areas])
    hit = reduce(lambda a, b: a | b, [overlaps(c, v) for c, v in areas if v] or [F.lit(False)])
    away = F.coalesce(remote, F.lit(False)) & F.lit(remote_ok)
    if remote_in and remote_in[1]:
        away = away & ((F.coalesce(F.size(remote_in[0]), F.lit(0)) <= 0) | overlaps(*remote_in))
    return unresolved | hit | away


def build_where(p: SearchParams, omit: frozenset[str] = frozenset()) -> Column:
    """The predicate of a search, without the constraints on the columns in ``omit``.

    With ``active`` set that column must be true, first of all. A facet's counts leave out the facet's own constraint and keep all others. Array columns form
    one conjunct together: a row passes if any of them overlaps.
    """
    parts: list[Column] = [F.coalesce(F.col(p.active), F.lit(False))] if p.active else []
    if p.text and p.text_columns:
        parts.append(contains_any(p.text_columns, p.text))
    parts += [in_or_none(c, v) for c, v in p.values.items() if c not in omit]
    areas = [overlaps(c, v) for c, v in p.overlaps.items() if v]
    if areas and not omit & set(p.overlaps):
        parts.append(reduce(lambda a, b: a | b, areas))
    if p.window:
        parts.append(window_holds(*p.window))
    if p.since:
        parts.append(F.coalesce(F.col(p.since[0]) >= F.lit(p.since[1]).cast("timestamp"), F.lit(False)))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def curated(df: DataFrame, names: DataFrame, column: str, name: str) -> DataFrame:
    """Rows whose ``column`` is in a list of names, case and outer white space apart."""
    keys = names.select(F.lower(clean(name)).alias("__key")).where("__key is not null").distinct()
    return df.withColumn("__key", F.lower(clean(column))).join(keys, "__key", "left_semi").drop("__key")
