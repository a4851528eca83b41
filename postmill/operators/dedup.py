"""Exact deduplication by several keys, with a stable survivor and the keys it stands for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmill.schema import dedup_key
from postmill.session import cut

_KEYS = "array<struct<source:string,source_external_id:string>>"


def own_key(source: str = "source", key: str = "source_external_id") -> Column:
    return F.struct(F.col(source).alias("source"), F.col(key).cast("string").alias("source_external_id"))


def union_keys(*arrays: Column) -> Column:
    """Set union of key arrays, the first place of each key kept; null arrays count as empty."""
    empty = F.array().cast(_KEYS)
    return F.array_distinct(F.concat(*[F.coalesce(a, empty) for a in arrays]))


def survivors(df: DataFrame, by: list[Column], key: str, order: list[Column] | None = None) -> DataFrame:
    """One row for each group of equal keys: the smallest ``key``, and ``siblings``, the others' keys.

    ``key`` may be a struct: ids of several sources are told apart by ``own_key`` only.

    Grouped by ``min_by`` with map-side combining instead of a window, so a group with a third of all
    rows is reduced before the exchange. Null keys of ``by`` form a group of their own; of equal
    smallest keys any one row stays, being a repeated row.
    """
    names = [f"__k{i}" for i in range(len(by))]
    rows = df.withColumns(dict(zip(names, by)))
    row = F.struct(*[F.col(c) for c in df.columns])
    rank = F.struct(*(order or []), F.col(key))
    grouped = rows.groupBy(*names).agg(F.min_by(row, rank).alias("__row"), F.collect_set(key).alias("__all"))
    return grouped.select("__row.*", F.array_sort(F.filter("__all", lambda k: k != F.col("__row")[key])).alias("siblings"))


def sibling_rows(df: DataFrame, by: list[Column], key: str) -> DataFrame:
    """``survivor, sibling``: the keys that each survivor stands for, one a row, for groups too large for an array."""
    names = [f"__k{i}" for i in range(len(by))]
    rows = df.withColumns(dict(zip(names, by))).select(*names, key).distinct()
    first = rows.groupBy(*names).agg(F.min(key).alias("survivor"))
    same = [rows[n].eqNullSafe(first[n]) for n in names]
    return rows.join(first, same).where(F.col("survivor") != F.col(key)).select("survivor", F.col(key).alias("sibling"))


def owners(batch: DataFrame, stored: DataFrame, company: str, title: str, location: str, key: str, active: str) -> DataFrame:
    """``batch`` with ``owner`` and ``outcome``: ``new``, ``self`` or ``other``.

    The owner is the active stored row of the same trimmed company, title and location (null as
    empty) with the smallest key. Only active rows own.
    """
    keys = ["__c", "__t", "__l"]
    named = lambda df: df.withColumns(dict(zip(keys, dedup_key(company, title, location))))
    held = named(stored.where(F.col(active))).groupBy(*keys).agg(F.min(key).alias("owner"))
    joined = named(batch).join(held, keys, "left").drop(*keys)
    return joined.withColumn("outcome", F.when(F.col("owner").isNull(), "new").when(F.col("owner") == F.col(key), "self").otherwise("other"))


def alias_targets(copies: DataFrame, aliases: str, key: str, targets: DataFrame, target_key: str) -> DataFrame:
    """Of each copy the first of its alias keys, in their order, that is a target other than itself."""
    wanted = copies.select(F.col(key).alias("copy"), F.posexplode(aliases).alias("pos", "alias"))
    there = targets.select(F.col(target_key).alias("alias")).distinct()
    hit = wanted.join(there, "alias").where(F.col("alias") != F.col("copy"))
    return hit.groupBy("copy").agg(F.min_by("alias", "pos").alias("target"))


def cross_keys(keys: str, source: Column) -> Column:
    """The keys of other sources; of the own source they are copies, never aliases."""
    return F.filter(union_keys(F.col(keys)), lambda k: k.source != source)


def alias_pass(batch: DataFrame, stored: DataFrame, key: str, keys: str, active: str, aliases: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Copies folded into the row they alias: first one in the batch, else an active stored one.

    Gives the batch without the copies and with the targets' keys extended, and the key additions
    of stored rows ``(target, keys)``. ``key`` is a struct column, ``keys`` an array of such structs;
    ``aliases`` has those of them that are aliases, if not all are. Of two rows that alias each other
    the smaller stays, and a copy of a row that is folded itself stays too: no key may get lost.
    """
    inside = cut(alias_targets(batch, aliases or keys, key, batch, key).withColumn("where", F.lit("batch")))
    back = inside.select(F.col("target").alias("copy"), F.col("copy").alias("target"))
    inside = inside.join(back.where(F.col("copy") < F.col("target")), ["copy", "target"], "left_anti")
    rest = batch.join(inside.select(F.col("copy").alias(key)), key, "left_anti")
    outside = alias_targets(rest, aliases or keys, key, stored.where(F.col(active)), key).withColumn("where", F.lit("stored"))
    folds = cut(inside.unionByName(outside))
    folds = folds.join(folds.select(F.col("copy").alias("target")), "target", "left_anti").select("copy", "target", "where")
    added = (
        batch.select(F.col(key).alias("copy"), F.col(keys).alias("had"))
        .join(folds, "copy")
        .groupBy("target", "where")
        .agg(F.flatten(F.collect_list(union_keys(F.array("copy"), "had"))).alias("all"))
        .select("target", "where", F.array_sort(F.array_distinct(F.filter("all", lambda k: k != F.col("target")))).alias("keys"))
    )
    left = batch.join(folds.select(F.col("copy").alias(key)), key, "left_anti")
    own = added.where("`where` = 'batch'").select(F.col("target").alias(key), F.col("keys").alias("__more"))
    left = left.join(own, key, "left").withColumn(keys, union_keys(F.col(keys), F.col("__more"))).drop("__more")
    return left, added.where("`where` = 'stored'").select("target", "keys")


def fold_keys(stored: DataFrame, folds: DataFrame, key: str, keys: str, seen: str, now: Column) -> DataFrame:
    """``stored`` with the keys of ``folds`` ``(target, keys)`` added to their targets, which thereby count as seen."""
    more = folds.groupBy(F.col("target").alias(key)).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("keys")))).alias("__more"))
    hit = F.col("__more").isNotNull()
    grown = F.filter(union_keys(F.col(keys), F.col("__more")), lambda k: k != F.col(key))
    joined = stored.join(more, key, "left")
    return joined.withColumn(keys, F.when(hit, grown).otherwise(F.col(keys))).withColumn(seen, F.when(hit, now).otherwise(F.col(seen))).drop("__more")


def retire_carriers(written: DataFrame, stored: DataFrame, key: str, keys: str, active: str, aliases: str | None = None) -> DataFrame:
    """Active stored rows that alias a row just written: ``carrier``, ``target`` and the keys to fold into it.

    A carrier that was written itself stays; only keys of another source are aliases, and of these
    only the ones in ``aliases``, if given.
    """
    there = written.select(F.col(key).alias("alias")).distinct()
    carriers = stored.where(F.col(active)).select(F.col(key).alias("carrier"), F.col(keys).alias("had"), F.posexplode(aliases or keys).alias("pos", "alias"))
    hit = carriers.where(F.col("alias.source") != F.col("carrier.source")).join(there, "alias")
    hit = hit.join(there.withColumnRenamed("alias", "carrier"), "carrier", "left_anti")
    first = hit.groupBy("carrier").agg(F.min_by(F.struct("alias", "had"), "pos").alias("f"))
    folded = union_keys(F.array("carrier"), F.col("f.had"))
    return first.select("carrier", F.col("f.alias").alias("target"), F.filter(folded, lambda k: k != F.col("f.alias")).alias("fold"))


def collapse(df: DataFrame, by: list[Column], key: str, active: str) -> DataFrame:
    """All rows with ``active`` false for each but the first active row of its group, and the keys that one gains.

    ``key`` is unique but for repeated rows.
    """
    names = [f"__k{i}" for i in range(len(by))]
    rows = df.withColumns(dict(zip(names, by)))
    groups = rows.where(F.col(active)).groupBy(*names).agg(F.min(key).alias("__first"), F.collect_set(key).alias("__all"))
    # The keys gained go to the row of the first key only; all other rows are inactive by not being one.
    firsts = groups.select(F.col("__first").alias("__f"), F.array_sort(F.filter("__all", lambda k: k != F.col("__first"))).alias("__gained"))
    joined = rows.drop(*names).join(firsts, F.col(key) == F.col("__f"), "left")
    stays = F.col(active) & F.col("__f").isNotNull()
    return joined.withColumn("gained", F.when(stays, F.col("__gained"))).withColumn(active, F.coalesce(stays, F.lit(False))).drop("__f", "__gained")


def latest(df: DataFrame, by: list[str], order: str) -> DataFrame:
    """The row with the largest ``order`` for each key: the latest action wins."""
    row = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(*[F.col(c).alias(f"__{c}") for c in by]).agg(F.max_by(row, order).alias("__row")).select("__row.*")


def first_n(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each cell; Spark limits groups before and after the exchange."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("__n", rank).where(F.col("__n") <= n).drop("__n")
