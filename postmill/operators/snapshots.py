"""What changed between full snapshots of a table (problem 6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def snapshot_changes(
    df: DataFrame,
    fields: list[str],
    *,
    snapshot: str = "snapshot_no",
    key: str = "id",
    version: str = "loaded_at",
) -> DataFrame:
    """Rows ``(snapshot, key, change, changed_fields)`` between each snapshot and the one before.

    Each snapshot row is unpivoted into signed cells ``(later snapshot, key, field, value)``: with
    sign +1 for its own snapshot and -1 for the next one present, besides one cell that marks that
    the key is present. Equal cells cancel; what is left classifies the key: a presence sum of +1 is
    ``added``, -1 is ``removed``, and 0 with any cell left over is ``changed``.

    Plan: duplicates within a snapshot are reduced first, with map-side combining, so that a key
    delivered very often never fills one task; then one exchange by key serves all later groupings.

    Defined results: rows with a null key or snapshot are left out; null and empty values differ; of
    several rows of a key in a snapshot the one with the largest ``version`` counts (a null version
    is the smallest); an empty table gives no rows; columns not named are never read.
    """
    s, k = "__snapshot", "__key"
    cols = [F.col(snapshot).alias(s), F.col(key).alias(k), F.col(version).alias("__version")]
    values = [F.col(f).cast("string").alias(f"__f{i}") for i, f in enumerate(fields)]
    rows = df.where(F.col(snapshot).isNotNull() & F.col(key).isNotNull()).select(*cols, *values)
    packed = F.struct("__version", *[f"__f{i}" for i in range(len(fields))])
    latest = rows.groupBy(s, k).agg(F.max(packed).alias("__row"))

    # a row for each snapshot, not for each record
    numbers = df.where(F.col(snapshot).isNotNull()).select(F.col(snapshot).alias(s)).distinct()
    order = Window.orderBy(s)
    numbers = numbers.select(s, F.lead(s).over(order).alias("__next"), F.lag(s).over(order).isNull().alias("__first"))

    cells = F.array(
        F.struct(F.lit(-1).alias("no"), F.lit(None).cast("string").alias("value")),
        *[F.struct(F.lit(i).alias("no"), F.col(f"__row.__f{i}").alias("value")) for i in range(len(fields))],
    )
    own = F.struct(F.col(s).alias("at"), F.lit(1).alias("sign"))
    after = F.struct(F.col("__next").alias("at"), F.lit(-1).alias("sign"))
    sides = F.when(F.col("__first"), F.array(after)).otherwise(F.array(own, after))
    signed = (
        latest.join(numbers, s)
        .repartition(k)
        .select(k, F.explode(sides).alias("side"), cells.alias("cells"))
        .where("side.at is not null")
        .select(k, F.col("side.at").alias(s), F.col("side.sign").alias("sign"), F.explode("cells").alias("cell"))
    )
    left = signed.groupBy(k, s, F.col("cell.no").alias("no"), F.col("cell.value").alias("value")).agg(
        F.sum("sign").alias("sum")
    )
    names = F.array(*[F.lit(f) for f in fields])
    out = (
        left.where("sum <> 0")
        .groupBy(k, s)
        .agg(
            F.coalesce(F.sum(F.when(F.col("no") == -1, F.col("sum"))), F.lit(0)).alias("presence"),
            F.array_sort(F.collect_set(F.when(F.col("no") >= 0, F.get(names, F.col("no"))))).alias("changed"),
        )
    )
    change = F.when(F.col("presence") > 0, "added").when(F.col("presence") < 0, "removed").otherwise("changed")
    return out.select(
        F.col(s).alias(snapshot),
        F.col(k).alias(key),
        change.alias("change"),
        F.when(F.col("presence") == 0, F.col("changed")).alias("changed_fields"),
    )
