"""Keyed writes as new snapshots: review queue, registrations, entities by business key."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

QUEUE_KEY = ["target_type", "target_id", "review_type"]


def queue_reviews(queue: DataFrame, new: DataFrame, order: str) -> DataFrame:
    """The queue after requests: a pending row of a request's key takes its reason and priority; without one, a pending row is added.

    Rows that are not pending stay. Of a batch's requests for one key the last counts. new: key, tenant_id, priority, reason and the order column.
    """
    last = new.groupBy(*QUEUE_KEY).agg(F.max(F.struct(order, "tenant_id", "priority", "reason")).alias("q"))
    flagged = last.withColumn("status", F.lit("pending"))
    kept = queue.join(flagged, [*QUEUE_KEY, "status"], "left").select(
        *QUEUE_KEY, "tenant_id", F.when(F.col("q").isNotNull(), F.col("q.priority")).otherwise(F.col("priority")).alias("priority"), F.when(F.col("q").isNotNull(), F.col("q.reason")).otherwise(F.col("reason")).alias("reason"), "status"
    )
    added = flagged.join(queue, [*QUEUE_KEY, "status"], "left_anti").select(*QUEUE_KEY, "q.tenant_id", "q.priority", "q.reason", "status")
    return kept.unionByName(added)


def registered(known: DataFrame, new: DataFrame, key: str = "source_id", digest: str = "content_hash") -> DataFrame:
    """new with action: skipped where key and content hash are known, updated where the hash differs, else inserted."""
    k = known.select(key, F.col(digest).alias("kg_hash")).dropDuplicates([key])
    action = F.when(F.col("kg_hash").isNull(), "inserted").when(F.col("kg_hash") == F.col(digest), "skipped").otherwise("updated")
    return new.join(k, key, "left").withColumn("action", action).drop("kg_hash")


def refreshed(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """A snapshot in which new values replace old ones, nulls in new rows leave the old value."""
    n = new.select(F.col(key), *[F.col(c).alias(f"kg_{c}") for c in new.columns if c != key])
    values = [F.coalesce(f"kg_{c}", c).alias(c) if f"kg_{c}" in n.columns else F.col(c) for c in old.columns if c != key]
    return old.join(n, key, "full").select(key, *values)


def reused(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of new without a row of the same business key in old; nulls in a key are equal to each other."""
    same = F.lit(True)
    for c in key:
        same = same & F.col(f"n.{c}").eqNullSafe(F.col(f"o.{c}"))
    return new.dropDuplicates(key).alias("n").join(old.alias("o"), same, "left_anti")
