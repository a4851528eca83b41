"""Offline evaluation: samples, pools, and measures of rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postmill.session import cut, small

# Cells up to this number are allocated by the driver; more of them by windows over the cells.
DRIVER_CELLS = 100_000


def allocate(cells: dict[str, int], target: int) -> dict[str, int]:
    """Seats for each cell by largest remainders: at least 1, at most the cell, ``target`` in all.

    Ties go to the smaller key; if the floor of 1 gives too many seats, they are taken from the
    largest allocations (ties: the larger key), never below 1.
    """
    total = sum(cells.values())
    if not total:
        return {}
    exact = {k: target * n / total for k, n in cells.items()}
    seats = {k: min(n, max(1, int(exact[k]))) for k, n in cells.items()}
    spare = target - sum(seats.values())
    for k in sorted(cells, key=lambda k: (-(exact[k] % 1), k)):
        if spare > 0 and seats[k] < cells[k]:
            seats[k] += 1
            spare -= 1
    while spare < 0:
        largest = max(((n, k) for k, n in seats.items() if n > 1), default=None)
        if largest is None:
            break
        seats[largest[1]] -= 1
        spare += 1
    return seats


def _allocate_rows(counted: DataFrame, target: int) -> DataFrame:
    """``allocate`` for any number of cells: ranks over ranges of them, never a list on the driver.

    With at least one seat for each cell the floors may exceed the target only if there are about as many
    cells as seats; then the largest allocations give seats back, all of them in whole rounds down to a level.
    """
    from postmill.operators.rank import global_rank

    total = counted.agg(F.sum("size")).first()[0] or 0
    exact = F.col("size") * F.lit(float(target)) / F.lit(float(total or 1))
    cells = cut(counted.withColumn("frac", exact - F.floor(exact)).withColumn("seats", F.least("size", F.greatest(F.lit(1), F.floor(exact).cast("bigint")))))
    spare = target - (cells.agg(F.sum("seats")).first()[0] or 0)
    if spare > 0:
        open_ = global_rank(cells.where("seats < size"), "frac", "cell", "at").select("cell", "at")
        cells = cells.join(open_, "cell", "left").withColumn("seats", F.col("seats") + (F.coalesce(F.col("at") < spare, F.lit(False))).cast("bigint")).drop("at")
    elif spare < 0:
        levels = {r["seats"]: r["n"] for r in cells.groupBy("seats").agg(F.count("*").alias("n")).collect()}  # at most sqrt(2 target) different ones
        level, over = max(levels), -spare
        while level > 1 and over > 0:
            high = sum(n for s, n in levels.items() if s >= level)
            if over < high:
                break
            over, level = over - high, level - 1
        cells = cells.withColumn("seats", F.least("seats", F.lit(level)))
        if over > 0 and level > 1:  # the last ones: of equal allocations the larger keys
            last = cells.where(F.col("seats") == level).select("cell").orderBy(F.col("cell").desc()).limit(over).withColumn("less", F.lit(1))
            cells = cells.join(last, "cell", "left").withColumn("seats", F.col("seats") - F.coalesce("less", F.lit(0))).drop("less")
    return cells.select("cell", "size", "seats")


def stratified_counts(df: DataFrame, cell: str, target: int) -> DataFrame:
    """Cells with their size and seats. Up to a bound the cells, never the rows, come to the driver."""
    counted = cut(df.groupBy(F.col(cell).alias("cell")).agg(F.count("*").alias("size")).where("cell is not null"))
    if counted.limit(DRIVER_CELLS + 1).count() > DRIVER_CELLS:
        return _allocate_rows(counted, target)
    rows = counted.collect()
    seats = allocate({r["cell"]: r["size"] for r in rows}, target)
    return df.sparkSession.createDataFrame([(r["cell"], r["size"], seats[r["cell"]]) for r in rows], "cell string, size bigint, seats bigint")


def stratified_sample(df: DataFrame, cell: str, key: str, target: int) -> DataFrame:
    """The first rows by key of each cell, as many as it has seats."""
    seats = small(stratified_counts(df, cell, target).select(F.col("cell").alias(cell), "seats"), DRIVER_CELLS)
    ranked = df.join(seats, cell).withColumn("__n", F.row_number().over(Window.partitionBy(cell).orderBy(key)))
    return ranked.where("__n <= seats").drop("__n", "seats")


def holdout(df: DataFrame, key: str, every: int = 5) -> DataFrame:
    """``df`` of labelled items with ``held_out`` for each ``every``-th by key; ranked over ranges of the key."""
    from postmill.operators.rank import global_rank

    ranked = global_rank(df.withColumn("__o", F.lit(0)), "__o", key, "__rank")
    return ranked.withColumn("held_out", F.col("__rank") % every == every - 1).drop("__rank", "__o")


def project(ranked: DataFrame, allowed: DataFrame, key: str = "id", rank: str = "rank") -> DataFrame:
    """A ranking restricted to allowed ids, its order kept and its places counted anew."""
    from postmill.operators.rank import global_rank

    kept = ranked.join(allowed.select(key).distinct(), key, "left_semi")
    return global_rank(kept.withColumn("__s", -F.col(rank)), "__s", key, "__rank").drop(rank, "__s").withColumnRenamed("__rank", rank)


def with_metadata(ranked: DataFrame, sample: DataFrame, key: str = "id") -> DataFrame:
    """Rows of a ranking with what the sample says of their items."""
    return ranked.join(sample, key, "left")


def top_label_count(ranked: DataFrame, label: str, n: int = 20, rank: str = "rank", column: str = "label") -> DataFrame:
    """How many of the first ``n`` bear a label: one row."""
    return ranked.where(F.col(rank) < n).agg(F.count_if(F.col(column) == label).alias("n"))


def precision_at_k(ranked: DataFrame, k: int, rank: str = "rank", label: str = "label", strict: str = "relevant", lenient: tuple[str, ...] = ("relevant", "borderline")) -> DataFrame:
    """Strict and lenient precision over the first ``k``; divided by the number of rows there."""
    top = ranked.where(F.col(rank) < k)
    hit = lambda names: F.coalesce(F.avg(F.coalesce(F.col(label).isin(list(names)), F.lit(False)).cast("double")), F.lit(None))
    return top.agg(hit([strict]).alias("strict"), hit(lenient).alias("lenient"))


def ndcg_at_k(ranked: DataFrame, k: int, gains: dict[str, float], rank: str = "rank", label: str = "label") -> DataFrame:
    """Discounted gain of the first ``k`` over the best order of the whole list; 0 without any gain.

    The best order needs only the counts of each label, so the list is never sorted as a whole: the
    ``k`` best gains are taken by a top-k.
    """
    table = F.create_map(*[F.lit(x) for pair in gains.items() for x in pair])
    scored = ranked.withColumn("__g", F.coalesce(F.element_at(table, F.col(label)), F.lit(0.0)))
    got = scored.where(F.col(rank) < k).agg(F.sum(F.col("__g") / F.log2(F.col(rank) + 2)).alias("got"))
    best = scored.select("__g").orderBy(F.col("__g").desc()).limit(k)
    best = best.withColumn("__r", F.row_number().over(Window.orderBy(F.col("__g").desc())) - 1)
    ideal = best.agg(F.sum(F.col("__g") / F.log2(F.col("__r") + 2)).alias("ideal"))
    both = got.unionByName(ideal, allowMissingColumns=True).agg(F.max("got").alias("got"), F.max("ideal").alias("ideal"))
    return both.select(F.when(F.col("ideal") > 0, F.coalesce("got", F.lit(0.0)) / F.col("ideal")).otherwise(0.0).alias("ndcg"))


def pool(lists: DataFrame, k: int, approach: str = "approach", rank: str = "rank", key: str = "id") -> DataFrame:
    """Union of the first ``k`` of each approach, each key once, in the order of first sight."""
    top = lists.where(F.col(rank) < k).groupBy(key).agg(F.min(F.struct(approach, rank)).alias("first"))
    order = Window.orderBy("first")  # at most k rows for each approach
    return top.select(key, (F.row_number().over(order) - 1).cast("bigint").alias("place"))


def entered(a: DataFrame, b: DataFrame, k: int, rank: str = "rank", key: str = "id") -> DataFrame:
    """Keys in the first ``k`` of ``a`` but not of ``b``."""
    return a.where(F.col(rank) < k).select(key).join(b.where(F.col(rank) < k).select(key), key, "left_anti")


def judged(ranked: DataFrame, labels: DataFrame, k: int, rank: str = "rank", key: str = "id", label: str = "label") -> DataFrame:
    """``ranked`` with its labels; a row among the first ``k`` without one is an error."""
    missing = F.raise_error(F.concat(F.lit("unlabelled item "), F.col(key).cast("string"))).cast("string")
    blank = F.coalesce(F.col(label), F.lit("")) == ""
    return ranked.join(labels.select(key, label), key, "left").withColumn(label, F.when(blank & (F.col(rank) < k), missing).otherwise(F.col(label)))


def retained(labels: DataFrame, pooled: DataFrame, items: DataFrame, key: str = "id", label: str = "label") -> DataFrame:
    """Labelled rows outside the pool whose item still exists."""
    told = labels.where(F.coalesce(F.col(label), F.lit("")) != "")
    return told.join(pooled.select(key), key, "left_anti").join(items.select(key), key, "left_semi")


def batches(df: DataFrame, order: str, size: int) -> DataFrame:
    """``df`` with the number of its batch in a total order, full batches of ``size``."""
    from postmill.operators.rank import global_rank

    ranked = global_rank(df.withColumn("__o", F.lit(0)), "__o", order, "__rank")
    return ranked.withColumn("batch", F.floor(F.col("__rank") / size)).drop("__rank", "__o")


__all__ = ["allocate", "batches", "entered", "holdout", "judged", "ndcg_at_k", "pool", "precision_at_k", "project", "retained", "stratified_counts", "stratified_sample", "top_label_count", "with_metadata"]
