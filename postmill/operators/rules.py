"""Cascades of rules over text: the cheapest first, each row in exactly one bucket."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions.text import min_years


@dataclass(frozen=True)
class Cascade:
    """Word patterns of a cascade. Matching is by whole ASCII words, case apart."""

    accept_all: tuple[str, ...] = ()  # all of these must match for a fast accept
    veto: str = ""  # what forbids a reject
    reject_any: tuple[str, ...] = ()
    max_years: int = 0


def word(column: Column, pattern: str) -> Column:
    """Whether a pattern stands in a text as whole words; null is no match."""
    return F.coalesce(column.rlike(rf"(?iu)(?<![A-Za-z0-9_])(?:{pattern})(?![A-Za-z0-9_])"), F.lit(False))


def first_rule(column: Column, rules: list[tuple[str, str]], default: str | None = None) -> Column:
    """The name of the first rule whose pattern stands in a text."""
    out = F.lit(default).cast("string")
    for name, pattern in reversed(rules):
        out = F.when(word(column, pattern), F.lit(name)).otherwise(out)
    return out


def route(df: DataFrame, cascade: Cascade, title: str, body: str, out: str = "route") -> DataFrame:
    """``df`` with the bucket of each row: accept, title_drop, years_drop or model.

    All rules are native and run in one stage; a costly model then sees the rows of ``model`` only.
    Null title and body match nothing and go to the model.
    """
    t = F.col(title)
    yes = [word(t, p) for p in cascade.accept_all]
    accept = yes[0] if yes else F.lit(False)
    for y in yes[1:]:
        accept = accept & y
    drop = F.lit(False)
    for p in cascade.reject_any:
        drop = drop | word(t, p)
    if cascade.veto:
        drop = drop & ~word(t, cascade.veto)
    years = F.coalesce(min_years(F.col(body)), F.lit(0)) > cascade.max_years
    return df.withColumn(out, F.when(accept, "accept").when(drop, "title_drop").when(years, "years_drop").otherwise("model"))


def decide(df: DataFrame, verdict: str, kind: str, error: str, route_col: str = "route") -> DataFrame:
    """The last bucket of each row, given the model's verdict on the rows routed to it.

    Only ``model_reject`` is remembered by a caller; ``error_skip`` is tried again in the next run.
    """
    m = F.col(route_col) == "model"
    return df.withColumn(
        "bucket",
        F.when(F.col(route_col) == "accept", "keep")
        .when(~m, F.col(route_col))
        .when(F.col(error).isNotNull(), "error_skip")
        .when(F.coalesce(F.col(verdict), F.lit(False)) & F.col(kind).isNotNull(), "keep")
        .otherwise("model_reject"),
    )


def counters(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.coalesce(F.col(column), F.lit("none")).alias("bucket")).agg(F.count("*").alias("n"))
