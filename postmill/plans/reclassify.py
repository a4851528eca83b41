"""Active rows judged again by the model, with a dry run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.functions.models import Classifier, classify, extract
from postmill.operators.lifecycle import active_scan, insert_new, merge
from postmill.operators.location import location_facets
from postmill.plans.refresh import KEY, LISTINGS, REJECTS
from postmill.plans.store import SnapshotStore
from postmill.session import cut


def reclassify(store: SnapshotStore, client: Classifier, now: str, dry_run: bool = False, limit: int | None = None, extractor=None, places: DataFrame | None = None) -> DataFrame:
    """Judge active rows again, by id, at most ``limit`` of them; gives ``key, outcome, kind_before, kind_after``.

    Outcomes: ``kept``, ``retyped``, ``delisted``, ``failed`` (the row stays as it is). A delisted row and its reject
    key are published together, so that the next refresh doesn't bring it back. Kept rows get their facets anew and,
    with an ``extractor``, their extracted fields; a deadline that is there stays. A dry run writes nothing.
    """
    number, listings, rejects = store.number, store.read("listings", LISTINGS), store.read("rejects", REJECTS)
    rows = cut(active_scan(listings, "is_listed", "source_external_id", limit))
    told = classify(rows, client, KEY, "title", "description_plain").withColumnRenamed("kind", "kind_after")
    keep = F.coalesce(F.col("relevant"), F.lit(False)) & F.col("kind_after").isNotNull()
    outcome = F.when(F.col("error").isNotNull(), "failed").when(~keep, "delisted").when(F.col("kind_before").eqNullSafe(F.col("kind_after")), "kept").otherwise("retyped")
    diff = cut(rows.select(*KEY, F.col("kind").alias("kind_before")).join(told, KEY).withColumn("outcome", outcome).select(*KEY, "outcome", "kind_before", "kind_after"))
    if dry_run:
        return diff
    gone = diff.where("outcome = 'delisted'").select(*KEY)
    kept = rows.drop("kind", "countries", "regions").join(diff.where("outcome in ('kept', 'retyped')").select(*KEY, F.col("kind_after").alias("kind")), KEY)
    if places is not None:
        kept = kept.join(location_facets(kept, KEY, "location", places), KEY, "left")
    if extractor is not None:
        found = extract(kept, extractor, KEY, "title", "description_plain").drop("error").withColumnRenamed("application_deadline", "told")
        had = [c for c in found.columns if c not in (*KEY, "told")]
        kept = kept.drop(*had).join(found, KEY, "left").withColumn("application_deadline", F.coalesce("application_deadline", "told")).drop("told")
    only = [c for c in kept.columns if c not in KEY]
    next_rows = merge(merge(listings, cut(kept), KEY, only=only, insert=False), gone.withColumn("is_listed", F.lit(False)), KEY, only=["is_listed"], insert=False)
    keys = gone.withColumn("last_seen", F.lit(now).cast("timestamp"))
    store.publish({"listings": next_rows, "rejects": insert_new(rejects, keys, KEY)}, expected=number, keys={"listings": ["company"]})
    return diff
