"""Stored state against a new delivery: what is known, what left, what is merged."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.schema import clean


def partition_seen(batch: DataFrame, keeps: DataFrame, rejects: DataFrame, key: list[str]) -> DataFrame:
    """``batch`` with ``seen``: ``reject``, ``keep`` or ``unseen``; a key in both is a reject."""
    k = keeps.select(*key).distinct().withColumn("__keep", F.lit(True))
    r = rejects.select(*key).distinct().withColumn("__reject", F.lit(True))
    seen = F.when(F.col("__reject"), "reject").when(F.col("__keep"), "keep").otherwise("unseen")
    return batch.join(k, key, "left").join(r, key, "left").withColumn("seen", seen).drop("__keep", "__reject")


def board_company(rows: DataFrame, board: str, company: str) -> DataFrame:
    """The company of each board: its only trimmed, non-blank one; null where there are none or several."""
    name = F.nullif(clean(company), F.lit(""))
    return rows.groupBy(board).agg(F.when(F.min(name) == F.max(name), F.min(name)).alias("company"))


def delisted(stored: DataFrame, delivered: DataFrame, complete: DataFrame, scope: list[str], key: list[str], active: str) -> DataFrame:
    """Active stored rows that a complete delivery of their scope no longer has.

    ``complete`` has the scopes whose full snapshot arrived, even if it is empty; a scope that failed
    or was not modified isn't among them, and nothing of it is delisted.
    """
    inside = stored.where(F.col(active)).join(complete.select(*scope).distinct(), scope, "left_semi")
    return inside.join(delivered.select(*key).distinct(), key, "left_anti")


def source_scope(targets: DataFrame, source: str = "source", active: str = "is_active") -> DataFrame:
    """Sources whose single active target's snapshot is the whole source: only these may delist by source."""
    return targets.where(F.col(active)).groupBy(source).agg(F.count("*").alias("n")).where("n = 1").select(source)


def target_count(targets: DataFrame, source: str = "source", active: str = "is_active") -> DataFrame:
    """Active targets of each source."""
    return targets.groupBy(source).agg(F.count_if(F.coalesce(F.col(active), F.lit(False))).alias("n"))


def crawl_health(targets: DataFrame, outcomes: DataFrame, key: list[str], now: Column) -> DataFrame:
    """``targets`` with what a crawl left: ``last_crawled_at``, ``last_error``, ``company``, ``etag``.

    ``outcomes`` has for each crawled target ``error, company, etag``. A success clears the error; a company is
    learned from a fresh resolution only, and an etag kept unless a new one came; a failure changes the error alone.
    """
    new = outcomes.select(*key, F.col("error").alias("__e"), F.col("company").alias("__c"), F.col("etag").alias("__t"), F.lit(True).alias("__hit"))
    joined, hit, good = targets.join(new, key, "left"), F.col("__hit").isNotNull(), F.col("__hit").isNotNull() & F.col("__e").isNull()
    return joined.withColumns(
        {
            "last_crawled_at": F.when(hit, now).otherwise(F.col("last_crawled_at")),
            "last_error": F.when(hit, F.col("__e")).otherwise(F.col("last_error")),
            "company": F.when(good, F.coalesce("__c", "company")).otherwise(F.col("company")),
            "etag": F.when(good, F.coalesce("__t", "etag")).otherwise(F.col("etag")),
        }
    ).drop("__e", "__c", "__t", "__hit")


def upsert_targets(targets: DataFrame, found: DataFrame, key: list[str], now: Column) -> DataFrame:
    """``targets`` with those a discovery found: new ones are active, known ones only get the time of discovery."""
    fresh = found.select(*key).distinct().withColumns({"is_active": F.lit(True), "last_seen_in_discovery_at": now})
    missing = {c: F.lit(None).cast(targets.schema[c].dataType) for c in targets.columns if c not in fresh.columns}
    return merge(targets, fresh.withColumns(missing), key, only=["last_seen_in_discovery_at"])


def ensured(df: DataFrame, row: DataFrame, key: str) -> DataFrame:
    """``df`` with a row of a given key in any case: that of ``row`` if there is none."""
    return df.unionByName(row.join(df.select(key), key, "left_anti"), allowMissingColumns=True)


def merge(stored: DataFrame, new: DataFrame, key: list[str], once: list[str] = (), always: dict[str, Column] | None = None, only: list[str] | None = None, insert: bool = True) -> DataFrame:
    """``stored`` with ``new`` merged in by natural key.

    ``once`` columns keep their stored value; ``always`` sets columns of every merged row; ``only``
    limits which columns are updated (others, a model's for instance, stay); without ``insert`` keys
    not stored are dropped. Both sides must have unique keys. One full (or left) join on the key;
    the result is meant to be written as the next snapshot. Merging the same delivery twice gives
    what merging it once gives.
    """
    columns = [c for c in stored.columns if c not in key]
    have = [c for c in new.columns if c not in key]
    right = new.select(*key, *[F.col(c).alias(f"__n_{c}") for c in have], F.lit(True).alias("__new"))
    left = stored.withColumn("__old", F.lit(True))
    joined = left.join(right, key, "full" if insert else "left")
    hit = F.coalesce(F.col("__new"), F.lit(False))
    out = []
    for c in columns:
        value = F.col(c)
        if c in have and (only is None or c in only):
            fresh = F.col(f"__n_{c}")
            value = F.when(hit & ~F.coalesce(F.col("__old"), F.lit(False)), fresh).otherwise(F.col(c)) if c in once else F.when(hit, fresh).otherwise(F.col(c))
        elif c in have:
            value = F.when(F.col("__old").isNull(), F.col(f"__n_{c}")).otherwise(F.col(c))
        if always and c in always:
            value = F.when(hit, always[c]).otherwise(value)
        out.append(value.alias(c))
    return joined.select(*key, *out)


def insert_new(stored: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """``stored`` and the rows of ``new`` whose key it lacks; a key that comes twice is taken once."""
    fresh = new.dropDuplicates(key).join(stored.select(*key), key, "left_anti")
    return stored.unionByName(fresh, allowMissingColumns=True)


def bump(stored: DataFrame, seen: DataFrame, key: list[str], column: str, now: Column) -> DataFrame:
    """``stored`` with ``column`` set to ``now`` where the key was seen."""
    mark = seen.select(*key).distinct().withColumn("__seen", F.lit(True))
    return stored.join(mark, key, "left").withColumn(column, F.when(F.col("__seen"), now).otherwise(F.col(column))).drop("__seen")


def bump_where(stored: DataFrame, condition: Column, column: str, now: Column) -> DataFrame:
    """The same by a predicate: a scope that was not modified."""
    return stored.withColumn(column, F.when(F.coalesce(condition, F.lit(False)), now).otherwise(F.col(column)))


def upsert_or_clear(stored: DataFrame, changes: DataFrame, key: str, value: str) -> DataFrame:
    """Changes with a value are merged, those with null delete the row."""
    kept = stored.join(changes.where(F.col(value).isNull()).select(key), key, "left_anti")
    return merge(kept, changes.where(F.col(value).isNotNull()), [key])


def stale(stored: str, computed: Column) -> Column:
    """Whether a stored fingerprint is missing or another than the computed one."""
    return ~F.col(stored).eqNullSafe(computed)


def changed_rows(before: DataFrame, after: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Rows whose derived columns come out other than stored; none on a second run."""
    old = before.select(*key, *[F.col(c).alias(f"__o_{c}") for c in columns])
    differs = reduce(lambda a, b: a | b, [~F.col(c).eqNullSafe(F.col(f"__o_{c}")) for c in columns])
    return after.join(old, key).where(differs).drop(*[f"__o_{c}" for c in columns])


def active_scan(df: DataFrame, active: str, key: str, limit: int | None = None) -> DataFrame:
    rows = df.where(F.col(active)).orderBy(key)
    return rows.limit(limit) if limit else rows


def walk_back(lists: DataFrame, newest: str, size: str, enough: int, depth: int) -> DataFrame:
    """The newest list with at least ``enough`` entries among the ``depth`` newest, else the largest of them."""
    near = lists.orderBy(F.col(newest).desc()).limit(depth)
    good = F.col(size) >= enough
    return near.orderBy(good.desc(), F.when(good, F.col(newest)).desc_nulls_last(), F.col(size).desc(), F.col(newest).desc()).limit(1)
