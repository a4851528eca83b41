"""One refresh: a delivery of listings against the stored state."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.functions.models import EXTRACTED, Classifier, RuleClassifier, classify, extract
from postmill.operators.dedup import alias_pass, cross_keys, fold_keys, own_key, owners, retire_carriers, survivors, union_keys
from postmill.operators.lifecycle import bump, delisted, insert_new, merge, partition_seen
from postmill.operators.location import location_facets
from postmill.operators.rules import Cascade, counters, decide, route
from postmill.plans.store import SnapshotStore
from postmill.schema import dedup_key
from postmill.session import cut

KEY = ["source", "source_external_id"]
LISTINGS = (
    "source string, source_external_id string, company string, title string, location string, description_plain string, url string, "
    "duplicate_keys array<struct<source:string,source_external_id:string>>, kind string, first_seen timestamp, last_seen timestamp, is_listed boolean, "
    "aliases array<struct<source:string,source_external_id:string>>, countries array<string>, regions array<string>, "
    + ", ".join(f"{f} {t}" for f, t in EXTRACTED.items())
)
# Columns that a delivery may have beside those of LISTINGS up to duplicate_keys.
OPTIONAL = {"preclassified_kind": "string", "application_deadline": "timestamp"}
REJECTS = "source string, source_external_id string, last_seen timestamp"


@dataclass
class Refresh:
    """What a refresh needs beside the delivery: a store, rules, and a model's client."""

    store: SnapshotStore
    cascade: Cascade
    client: Classifier = None
    delisting_sources: tuple[str, ...] = ()
    places: DataFrame = None
    extractor: object = None

    def _located(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the facets of their location, made at every write; null without a dictionary."""
        if self.places is None:
            none = F.lit(None).cast("array<string>")
            return rows.withColumns({"countries": none, "regions": none})
        return rows.join(location_facets(rows, KEY, "location", self.places), KEY, "left")

    def _extracted(self, keeps: DataFrame) -> DataFrame:
        """``keeps`` with the extracted fields; a deadline of the feed wins, and preclassified rows aren't read."""
        if self.extractor is None:
            return keeps
        found = extract(keeps.where("preclassified_kind is null"), self.extractor, KEY, "title", "description_plain").drop("error")
        found = found.withColumnRenamed("application_deadline", "told")
        return keeps.join(found, KEY, "left").withColumn("application_deadline", F.coalesce("application_deadline", "told")).drop("told")

    def run(self, delivery: DataFrame, complete: DataFrame, now: str, offsets: dict | None = None, not_modified: DataFrame | None = None) -> DataFrame:
        """Delist, dedup, split by what is known, route and judge the unseen, merge, retire, publish; gives the counts.

        ``delivery`` has the columns of LISTINGS up to ``duplicate_keys``; ``complete`` the
        ``(source, company)`` scopes whose full snapshot arrived. What left is delisted first, so
        that it owns no repost. A survivor whose role another active row owns, and a copy that
        aliases a row of the batch or an active one, is folded: its keys go to that row, which
        counts as seen. ``aliases`` keeps the delivered keys of other sources; folded keys aren't
        aliases. A verdict is asked for unseen rows that no rule decides. Only rejects of the model
        are remembered; other drops are judged again in the next run. A delisted row that comes
        again is active again. A delivery may have the columns of OPTIONAL: an unseen row with
        ``preclassified_kind`` is kept as that without rules or model. Keeps go to the extractor, if
        there is one; every written row has its location's facets by ``places``. ``not_modified`` has the ``(source, company)``
        scopes (a null company: the whole source) whose feed said that nothing changed: their active rows count as
        seen, and none is delisted. Offsets become current with the state, so a failed run is repeated
        from the old ones. Listings are kept in parts by company; only parts with a changed row are written.
        """
        store, at = self.store, F.lit(now).cast("timestamp")
        stored, rejects, number = store.read("listings", LISTINGS), store.read("rejects", REJECTS), store.number
        stored = stored.withColumn("aliases", F.coalesce("aliases", cross_keys("duplicate_keys", F.col("source"))))
        delivery = delivery.withColumns({c: F.lit(None).cast(t) for c, t in OPTIONAL.items() if c not in delivery.columns})
        gone = delisted(
            stored.where(F.col("source").isin(list(self.delisting_sources))), delivery, complete, ["source", "company"], KEY, "is_listed"
        ).select(*KEY, F.lit(False).alias("is_listed"))
        gone = cut(gone)
        held = merge(stored, gone, KEY, only=["is_listed"], insert=False)
        bumped = None
        if not_modified is not None:
            scopes = not_modified.select(F.col("source").alias("__s"), F.col("company").alias("__c")).distinct()
            same = (F.col("source") == F.col("__s")) & (F.col("__c").isNull() | (F.col("company") == F.col("__c")))
            bumped = cut(held.where("is_listed").join(scopes, same, "left_semi").select(*KEY))
            held = bump(held, bumped, KEY, "last_seen", at)
        held = cut(held)
        keyed = held.withColumn("key", own_key())
        one = survivors(delivery.withColumn("key", own_key()), dedup_key("company", "title", "location"), "key")
        one = one.withColumn("aliases", cross_keys("duplicate_keys", F.col("source")))
        owned = cut(owners(one, keyed, "company", "title", "location", "key", "is_listed"))
        had = keyed.select("key", F.col("duplicate_keys").alias("had"), F.col("aliases").alias("had_aliases"), F.col("application_deadline").alias("had_deadline"))
        mine = owned.where("outcome <> 'other'").join(had, "key", "left")
        mine = mine.withColumns({"duplicate_keys": union_keys("had", "duplicate_keys", "siblings"), "aliases": union_keys("had_aliases", "aliases"), "application_deadline": F.coalesce("application_deadline", "had_deadline")})
        left, folds = alias_pass(cut(mine.drop("siblings", "owner", "outcome", "had", "had_aliases", "had_deadline")), keyed, "key", "duplicate_keys", "is_listed", "aliases")
        copies = owned.where("outcome = 'other'").select(F.col("owner").alias("target"), union_keys(F.array("key"), "siblings").alias("keys"))
        folds = cut(copies.unionByName(folds))
        batch = cut(partition_seen(left.drop("key"), held, rejects, KEY))
        unseen = batch.where("seen = 'unseen'")
        routed = route(unseen.where("preclassified_kind is null"), self.cascade, "title", "description_plain")
        asked = classify(routed.where("route = 'model'"), self.client or RuleClassifier(), KEY, "title", "description_plain")
        pre = unseen.where("preclassified_kind is not null").withColumns({"kind": F.col("preclassified_kind"), "bucket": F.lit("keep")})
        judged = cut(decide(routed.join(asked, KEY, "left"), "relevant", "kind", "error").unionByName(pre, allowMissingColumns=True))
        keeps = judged.where("bucket = 'keep'").select(*batch.drop("seen").columns, "kind")
        keeps = cut(self._located(self._extracted(keeps)))
        stamp = {"first_seen": at, "last_seen": at, "is_listed": F.lit(True)}
        next_rows = merge(held, keeps.withColumns(stamp), KEY, once=["first_seen"])
        known = self._located(batch.where("seen = 'keep'").drop("seen")).withColumns({"last_seen": at, "is_listed": F.lit(True)})
        facts = ["company", "title", "location", "description_plain", "url", "duplicate_keys", "aliases", "countries", "regions", "application_deadline", "last_seen", "is_listed"]
        next_rows = merge(next_rows, known, KEY, only=facts, insert=False).withColumn("key", own_key())
        next_rows = cut(fold_keys(next_rows, folds, "key", "duplicate_keys", "last_seen", at))
        written = keeps.select(own_key().alias("key")).unionByName(known.select(own_key().alias("key")))
        retired = cut(retire_carriers(written, next_rows, "key", "duplicate_keys", "is_listed", "aliases"))
        next_rows = fold_keys(next_rows, retired.select("target", F.col("fold").alias("keys")), "key", "duplicate_keys", "last_seen", at).drop("key")
        off = retired.select("carrier.*", F.lit(False).alias("is_listed"))
        final = merge(next_rows, off, KEY, only=["is_listed"], insert=False)
        off = off.unionByName(gone)
        seen_again = batch.where("seen = 'reject'").select(*KEY, at.alias("last_seen"))
        fresh = judged.where("bucket = 'model_reject'").select(*KEY, at.alias("last_seen"))
        next_rejects = insert_new(merge(rejects, seen_again, KEY, insert=False), fresh, KEY)
        counts = cut(counters(judged, "bucket").unionByName(counters(batch.where("seen <> 'unseen'"), "seen")).unionByName(off.agg(F.lit("delisted").alias("bucket"), F.count("*").alias("n"))))
        # Parts of the companies of all rows that this run changed, as they were and as they are.
        changed = [f.select(*KEY) for f in (gone, keeps, known, off)] + [f.select("target.*") for f in (folds, retired)] + ([bumped] if bumped is not None else [])
        touched = reduce(DataFrame.unionByName, changed).distinct()
        final = cut(final)
        part = store.part_of(["company"]).alias("part")
        both = stored.select(*KEY, part).unionByName(final.select(*KEY, part)).join(touched, KEY, "left_semi")
        only = sorted(r["part"] for r in both.select("part").distinct().collect())
        store.publish(
            {"listings": final.where(store.part_of(["company"]).isin(only)) if only else final.limit(0), "rejects": next_rejects},
            offsets, expected=number, keys={"listings": ["company"]}, only={"listings": only} if number else None,
        )
        return counts
