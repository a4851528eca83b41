"""Facet counts: distinct roles for each value, each facet without its own constraint."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.operators.predicates import SearchParams, build_where
from postmill.schema import role_key


def _pair(name: str):
    return lambda v: F.struct(F.lit(name).alias("facet"), v.alias("value"))


def facet_counts(df: DataFrame, params: SearchParams, facets: dict[str, str], company: str, title: str) -> DataFrame:
    """Rows ``facet, value, n``: distinct (company, title) for each value of each facet.

    ``facets`` maps columns to ``scalar``, ``none`` (null counts as "none") or ``array``. A row counts
    for a facet if it passes the search without that facet's constraint. All facets come from one
    scan: each row is expanded into the (facet, value) pairs it counts for, and two groupings with
    map-side combining do the distinct count. Null values of scalar facets are skipped.
    """
    c, t = role_key(company, title)
    arrays = frozenset(k for k, kind in facets.items() if kind == "array")
    pairs = []
    for name, kind in facets.items():
        passes = build_where(params, omit=arrays if kind == "array" else frozenset({name}))
        if kind == "array":
            values = F.array_distinct(F.filter(F.transform(name, lambda v: F.trim(v)), lambda v: v.isNotNull() & (v != "")))
        else:
            value = F.col(name).cast("string")
            values = F.array(F.coalesce(value, F.lit("none")) if kind == "none" else value)
        pairs.append(F.when(passes & values.isNotNull(), F.transform(values, _pair(name))))
    empty = F.array().cast("array<struct<facet:string,value:string>>")
    every = reduce(lambda a, b: F.concat(a, b), [F.coalesce(p, empty) for p in pairs], empty)
    return (
        df.select(c.alias("__c"), t.alias("__t"), F.explode(every).alias("p"))
        .where("p.value is not null and __c is not null and __t is not null")
        .select("p.facet", "p.value", "__c", "__t")
        .distinct()
        .groupBy("facet", "value")
        .agg(F.count("*").alias("n"))
    )


def rail(counts: DataFrame, pinned: list[str], show: int) -> DataFrame:
    """Values of one facet as shown: pinned ones first (0 where absent), then by count, then by value."""
    spark = counts.sparkSession
    pins = spark.createDataFrame([(p,) for p in pinned], "value string")
    rows = counts.select("value", "n").join(pins.withColumn("pin", F.lit(0)), "value", "full")
    rows = rows.select("value", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("pin", F.lit(1)).alias("pin"))
    return rows.orderBy("pin", F.col("n").desc(), "value").limit(max(show, len(pinned))).drop("pin")
