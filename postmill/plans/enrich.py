"""Signatures and vectors of active rows, made anew only where they are stale."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions.contracts import distill
from postmill.functions.models import Embedder, embed
from postmill.functions.text import fingerprint
from postmill.operators.lifecycle import merge, stale
from postmill.operators.rank import needs_embedding, render_lines
from postmill.plans.store import SnapshotStore
from postmill.schema import valid_signature
from postmill.session import cut

KEY = ["source", "source_external_id"]
ENRICHED = "source string, source_external_id string, signature string, signature_fingerprint string, embedding array<double>, embedding_model string, template_version int"


def signature_text(title: str = "title", signature: str = "signature") -> Column:
    """The text that is embedded: the title, the role, what it requires."""
    s = valid_signature(F.col(signature))
    role = F.concat(s["level"], F.lit(" "), F.array_join(s["domains"], ", "), F.lit(" — "), s["focus"])
    return render_lines(("Title: ", F.trim(F.col(title))), ("Role: ", role), ("Requires: ", F.array_join(s["skills"], ", ")))


@dataclass
class Enrichment:
    """What a pass needs: the store of enriched rows, the clients, and the versions that are current."""

    store: SnapshotStore
    signer: object
    embedder: Embedder
    model: str
    template: int
    prompt: int = 1
    aliases: dict[str, str] = field(default_factory=dict)
    table: str = "enriched"

    def _sweep(self, active: DataFrame) -> dict[str, int]:
        """Vectors for rows that have a signature and no current vector; published at once."""
        number, state = self.store.number, self.store.read(self.table, ENRICHED)
        wanted = state.where(needs_embedding("signature", "embedding", "embedding_model", "template_version", self.model, self.template))
        wanted = wanted.join(active.select(*KEY, "title"), KEY).where(valid_signature(F.col("signature")).isNotNull())
        made = cut(embed(wanted.select(*KEY, signature_text().alias("text")), self.embedder, KEY, "text"))
        good = made.where("error is null")
        counts = {"embedded": good.count(), "embed_failed": made.where("error is not null").count()}
        if counts["embedded"]:
            new = good.select(*KEY, F.col("vector").alias("embedding"), F.lit(self.model).alias("embedding_model"), F.lit(self.template).alias("template_version"))
            self.store.publish({self.table: merge(state, new, KEY, insert=False)}, expected=number)
        return counts

    def run(self, listings: DataFrame) -> dict[str, int]:
        """One pass over the active rows of ``listings`` (``kind``, ``field``, ``company``, ``title``, ``description_plain``).

        First all vectors that can be made, so that a restart makes rows rankable before it asks for signatures; then
        signatures of rows whose fingerprint is stale, saved together with it while the vector is cleared; then the
        vectors of these. A failing row keeps its old state and is tried again in the next pass.
        """
        active = cut(listings.where("is_listed").select(*KEY, "company", "title", "description_plain", "kind", "field"))
        first = self._sweep(active)
        number, state = self.store.number, self.store.read(self.table, ENRICHED)
        now = fingerprint(self.prompt, F.col("title"), F.col("company"), F.col("description_plain"), F.col("kind"), F.col("field"))
        rows = active.withColumn("fp", now).join(state.select(*KEY, "signature_fingerprint"), KEY, "left")
        old = cut(rows.where(stale("signature_fingerprint", F.col("fp"))))
        made = cut(distill(old, self.signer, KEY, "title", "description_plain", "kind", "field", self.aliases))
        good = made.where("signature is not null").join(old.select(*KEY, "fp"), KEY)
        none = {"embedding": F.lit(None).cast("array<double>"), "embedding_model": F.lit(None).cast("string"), "template_version": F.lit(None).cast("int")}
        good = cut(good.select(*KEY, "signature", F.col("fp").alias("signature_fingerprint")).withColumns(none))
        signed = good.count()
        if signed:
            self.store.publish({self.table: merge(state, good, KEY)}, expected=number)
        last = self._sweep(active)
        scanned, n_old = active.count(), old.count()
        return {
            "scanned": scanned, "signed": signed, "sign_failed": n_old - signed, "embedded": first["embedded"] + last["embedded"],
            "embed_failed": last["embed_failed"], "up_to_date": scanned - n_old,
        }
