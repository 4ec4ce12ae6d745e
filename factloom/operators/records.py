"""Decisions as batches for the store: what is taken in, promoted or learned becomes assertions, which the store judges like any others."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .writes import Store

#: The columns that a batch for the store has besides its own.
_NONE = {"human": "string", "why": "string", "reopen_if": "string", "verification_id": "long", "derived_from": "array<long>", "valid_from": "timestamp_ntz", "valid_to": "timestamp_ntz", "supersedes": "long"}


def batch(rows: DataFrame) -> DataFrame:
    """rows (id, scope, subject, predicate, value, kind, confidence, source, ...) with the columns that they lack, as nulls; their writer verifies nothing."""
    lacking = {c: F.lit(None).cast(t) for c, t in _NONE.items() if c not in rows.columns}
    return rows.withColumns(lacking).withColumn("is_verifier", F.lit(False))


def facts(candidates: DataFrame, scope: str, first_id: int) -> DataFrame:
    """Fact candidates with a verdict (prose.ingestable) as a batch: the accepted ones, unverified, each with its line as source. Ids follow the candidates'."""
    new = candidates.where("verdict = 'accepted'")
    return batch(new.select((F.col("id") + first_id).alias("id"), F.lit(scope).alias("scope"), "subject", "predicate", F.col("object").cast("double").alias("value"), F.lit("measured").alias("kind"), F.lit("unverified").alias("confidence"), F.col("locator").alias("source")))


def promote(store: Store, proposals: DataFrame, scope: str, name: str, first_id: int) -> DataFrame:
    """Appends the accepted proposals (id, status, reviewed_by, subject, predicate, value, source), confirmed by the human who reviewed them; the proposals with promoted_to, the assertion that each became or already was, and refused, why the store took one not.

    The assertions and what they were made from land together: a promotion that was sent before comes back as it was.
    """
    rows = proposals.where("status = 'accepted'").select((F.col("id") + first_id).alias("id"), F.lit(scope).alias("scope"), "subject", "predicate", "value", F.lit("state").alias("kind"), F.lit("confirmed-by-human").alias("confidence"), "source", F.col("reviewed_by").alias("human"))
    said = store.append(batch(rows), name).select((F.col("id") - first_id).alias("id"), F.when(F.col("reason").isNull(), F.coalesce("existing", "id")).alias("promoted_to"), F.col("reason").alias("refused"))
    return proposals.join(said, "id", "left")


def preferences(decisions: DataFrame, first_id: int) -> DataFrame:
    """Promotions (people.promotions) as rows of preferences to append, those that are skipped left out: id, scope, signature, tier, occasions, humans, binding and supersedes. Ids are dealt in the order of scope and signature within each scope."""
    kept = decisions.where(F.col("action").isin("create", "supersede"))
    place = F.row_number().over(Window.partitionBy("scope").orderBy("signature"))
    return kept.select(F.concat_ws(":", "scope", (place + first_id - 1).cast("string")).alias("id"), "scope", "signature", "tier", "occasions", "humans", "binding", "supersedes")
