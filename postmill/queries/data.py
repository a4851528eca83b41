"""Problems 4 and 6 over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.operators.snapshots import snapshot_changes
from postmill.operators.timestamps import number_instant, text_instants
from postmill.session import table

SNAPSHOT_FIELDS = ["board", "title", "location", "employmentType", "workplaceType", "isListed"]


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    boards = table(spark, d, "boards").select("board", F.col("tz").alias("__tz"), "date_style")
    ashby = table(spark, d, "ashby").select("board", "id", "publishedAt").join(boards, "board", "left")
    simplify = table(spark, d, "simplify").select("id", "date_posted", "date_updated", "tz")
    named = lambda df, feed, field: df.select(
        F.lit(feed).alias("feed"), F.col("id").alias("record_id"), F.lit(field).alias("field_name"), "epoch_us"
    )
    published = text_instants(ashby, ["id"], "publishedAt", "__tz", "date_style")
    updated = text_instants(simplify, ["id"], "date_updated", "tz", F.lit("ymd"))
    posted = simplify.select("id", number_instant(F.col("date_posted")).alias("epoch_us")).where("epoch_us is not null")
    return (
        named(published, "ashby", "publishedAt")
        .unionByName(named(posted, "simplify", "date_posted"))
        .unionByName(named(updated, "simplify", "date_updated"))
        .distinct()
    )


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return snapshot_changes(table(spark, d, "ashby_snapshots"), SNAPSHOT_FIELDS).select("snapshot_no", "id", "change")


def p6_fields(spark: SparkSession, d: str) -> DataFrame:
    """The fields that changed, as one comma-separated string in the order of their names."""
    changes = snapshot_changes(table(spark, d, "ashby_snapshots"), SNAPSHOT_FIELDS).where("change = 'changed'")
    return changes.select("snapshot_no", "id", F.array_join("changed_fields", ",").alias("fields"))


QUERIES = {"p4_found": p4_found, "p6_found": p6_found, "p6_fields": p6_fields}

_STATES = """
WITH ranked AS (
    SELECT *, row_number() OVER (PARTITION BY snapshot_no, id ORDER BY loaded_at DESC) AS r FROM ashby_snapshots
), state AS (SELECT * FROM ranked WHERE r = 1),
order_of AS (
    SELECT snapshot_no, lag(snapshot_no) OVER (ORDER BY snapshot_no) AS before
    FROM (SELECT DISTINCT snapshot_no FROM ashby_snapshots)
), now AS (SELECT s.*, o.before FROM state s JOIN order_of o USING (snapshot_no) WHERE o.before IS NOT NULL),
was AS (SELECT s.*, o.snapshot_no AS after FROM state s JOIN order_of o ON o.before = s.snapshot_no)
"""
_DIFFERS = " OR ".join(f'n."{f}" IS DISTINCT FROM w."{f}"' for f in SNAPSHOT_FIELDS)

SQL = {
    "p6_found": f"""{_STATES}
SELECT coalesce(n.snapshot_no, w.after) AS snapshot_no, coalesce(n.id, w.id) AS id,
       CASE WHEN w.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM now n FULL JOIN was w ON n.id = w.id AND n.snapshot_no = w.after
WHERE n.id IS NULL OR w.id IS NULL OR {_DIFFERS}""",
    "p6_fields": f"""{_STATES}
SELECT n.snapshot_no, n.id, concat_ws(',', {", ".join(f"CASE WHEN n.\"{f}\" IS DISTINCT FROM w.\"{f}\" THEN '{f}' END" for f in sorted(SNAPSHOT_FIELDS))}) AS fields
FROM now n JOIN was w ON n.id = w.id AND n.snapshot_no = w.after WHERE {_DIFFERS}""",
}
