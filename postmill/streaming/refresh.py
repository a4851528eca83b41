"""Refresh as a stream: files of deliveries, a bounded number of boards in each micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from postmill.plans.pointer import Pointers
from postmill.plans.refresh import Refresh


def stream_refresh(
    spark: SparkSession, folder: str, schema: str, refresh: Refresh, checkpoint: str, now: Callable[[int], str], boards_per_batch: int = 10, on_error: Callable[[int, Exception], None] | None = None
) -> StreamingQuery:
    """Run ``refresh`` on each micro-batch of at most ``boards_per_batch`` files, one file a board's full snapshot.

    A row without ``source_external_id`` only names its ``(source, company)``: that is how the file of an empty board,
    whose listings all left, says which board it is. If the rows have a ``status``, a scope with ``not_modified`` counts as
    seen, and one with ``error`` is left alone; neither delists. A batch's number is its offset in the store: a batch that was
    published but not committed before a crash is recognised and not applied twice. Without ``on_error`` a failed batch
    stops the query and is repeated from the checkpoint; with it the batch is reported, its rows are set aside
    beside the checkpoint, and they come again with the next batch.
    """
    aside = Pointers(spark, f"{checkpoint.rstrip('/')}-aside")

    def waiting() -> list[str]:
        fs, root = aside.fs(), aside.path()
        return sorted(s.getPath().getName() for s in fs.listStatus(root)) if fs.exists(root) else []

    def apply(df: DataFrame, number: int) -> None:
        if refresh.store.offsets.get("batch", -1) >= number:
            return
        old = waiting()
        rows = df
        if old:
            rows = df.unionByName(spark.read.schema(df.schema).parquet(*[f"{aside.root}/{name}" for name in old]))
        status = F.col("status") if "status" in rows.columns else F.lit("ok")
        status = F.coalesce(status, F.lit("ok"))
        scopes = lambda cond: rows.where(cond).select("source", "company").distinct()
        bad = scopes(status.isin("not_modified", "error"))
        try:
            listings = rows.where(F.col("source_external_id").isNotNull()).drop("status")
            refresh.run(listings, scopes(~status.isin("not_modified", "error")).join(bad, ["source", "company"], "left_anti"), now(number), {"batch": number}, scopes(status == "not_modified"))
        except Exception as e:  # noqa: BLE001 - reported to the caller
            if on_error is None:
                raise
            df.write.mode("overwrite").parquet(f"{aside.root}/batch-{number}")
            on_error(number, e)
            return
        for name in old:
            aside.remove(name)

    files = spark.readStream.schema(schema).option("maxFilesPerTrigger", boards_per_batch).parquet(folder)
    return files.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def recent_by_source(events: DataFrame, time: str, source: str, window: str = "3 days", slide: str = "1 day", late: str = "1 day") -> DataFrame:
    """Sightings in a sliding window for each source, late rows bounded by a watermark."""
    return events.withWatermark(time, late).groupBy(F.window(time, window, slide).alias("w"), source).agg(F.count("*").alias("n"))


