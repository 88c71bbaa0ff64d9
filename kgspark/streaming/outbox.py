"""Structured Streaming: the outbox applied to a graph snapshot, latest states, and windowed event counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from kgspark.operators.graph import latest

#: Kinds of aggregates the projection knows; events of others are put aside and stay unprocessed.
KNOWN = ("entity", "relation", "assertion")


def pending(events: DataFrame, limit: int | None = None) -> DataFrame:
    """Unprocessed events, one of each (type, id, event), oldest first."""
    rows = events.where("not processed").groupBy("aggregate_type", "aggregate_id", "event_type").agg(F.min("id").alias("id"), F.min("created_at").alias("created_at"))
    return rows.orderBy("created_at", "id").limit(limit) if limit else rows


def apply(vertices: DataFrame, events: DataFrame, payload: DataFrame) -> DataFrame:
    """Vertices after events: the last event of an id decides; upserts take the payload's row, deletes drop it. Running it again changes nothing."""
    last = latest(events.select("aggregate_id", "event_type", "created_at", "id"), "aggregate_id", "created_at", "id").select(F.col("aggregate_id").alias("vid"), "event_type")
    kept = vertices.join(last, vertices["id"] == F.col("vid"), "left_anti")
    put = payload.join(last.where("event_type = 'upsert'"), payload["id"] == F.col("vid"), "left_semi")
    return kept.unionByName(put.select(*vertices.columns))


def without_vertices(edges: DataFrame, events: DataFrame) -> DataFrame:
    """Edges after events: those that a deleted vertex ends go with it."""
    last = latest(events.select("aggregate_id", "event_type", "created_at", "id"), "aggregate_id", "created_at", "id")
    gone = last.where("event_type = 'delete'").select(F.col("aggregate_id").alias("gone"))
    return edges.join(gone, F.col("source_id") == F.col("gone"), "left_anti").join(gone, F.col("target_id") == F.col("gone"), "left_anti")


def projected(entities: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A full projection: vertices (active entities with label and layer tag) and edges both of whose ends are among them."""
    label = F.array_join(F.transform(F.split("type", "_"), F.initcap), "")
    tag = F.when(F.col("layer") == "l3_brand", "L3").when(F.col("layer") == "l2_industry", "L2").otherwise("L1")
    v = entities.where("status = 'active'").select("id", "name", label.alias("label"), tag.alias("layer_tag"))
    ids = v.select(F.col("id").alias("vid"))
    return v, relations.join(ids, F.col("source_id") == F.col("vid"), "left_semi").join(ids, F.col("target_id") == F.col("vid"), "left_semi")


def reified(assertions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Assertions (id, subject_id, predicate, object_id) as vertices of their own with SUBJECT and OBJECT edges; a null end has no edge."""
    v = assertions.select("id", F.col("predicate").alias("name"), F.lit("Assertion").alias("label"))
    edge = lambda c, kind: assertions.where(F.col(c).isNotNull()).select(F.col("id").alias("source_id"), F.col(c).alias("target_id"), F.lit(kind).alias("relation_type"))
    return v, edge("subject_id", "SUBJECT").unionByName(edge("object_id", "OBJECT"))


def put_aside(failed: DataFrame, before: DataFrame | None, error: str) -> DataFrame:
    """Quarantine rows after failed events: attempts go up by one, the last error is cut to 500 characters, the event stays unprocessed."""
    new = failed.withColumns({"attempts": F.lit(1), "last_error": F.lit(error[:500])})
    if before is None:
        return new
    cols = [c for c in failed.columns if c != "id"]
    both = before.select(new.columns).unionByName(new)
    return both.groupBy("id").agg(F.max_by(F.struct(*cols, "last_error"), "attempts").alias("r"), F.sum("attempts").cast("int").alias("attempts")).select("id", "r.*", "attempts").select(new.columns)


def start(spark: SparkSession, path: str, schema: str, sink: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True, quarantine: str | None = None) -> StreamingQuery:
    """Read event files as they come and hand each batch, without repeats and of known kinds, to an idempotent sink.

    Events of other kinds, and whole batches whose sink fails, are written to the quarantine folder (attempt, last_error) before the
    checkpoint moves on, so none is lost; each batch writes a folder of its own, which a repeated batch overwrites.
    Without a quarantine, events of other kinds go to a folder beside the checkpoint, and a sink that fails stops the query, which takes the batch up again when restarted.
    """
    events = spark.readStream.schema(schema).parquet(path)

    def aside(rows: DataFrame, number: int, error: str, kind: str) -> None:
        if rows.isEmpty():
            return
        rows.withColumns({"attempts": F.lit(1), "last_error": F.lit(error[:500])}).write.mode("overwrite").parquet(f"{quarantine or checkpoint + '-aside'}/{kind}-{number}")

    def batch(df: DataFrame, number: int) -> None:
        rows = df.dropDuplicates(["aggregate_type", "aggregate_id", "event_type", "id"])
        known = F.coalesce(F.col("aggregate_type").isin(*KNOWN), F.lit(False))
        aside(rows.where(~known), number, "unknown aggregate type", "unknown")
        try:
            sink(rows.where(known), number)
        except Exception as e:
            if quarantine is None:
                raise
            aside(rows.where(known), number, f"{type(e).__name__}: {e}", "failed")

    writer = events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch)
    return (writer.trigger(availableNow=True) if once else writer).start()


def tumbling(events: DataFrame, width: str) -> DataFrame:
    """Counts and sums per window and type; on a stream, call withWatermark on a timestamp column first."""
    w = events.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return w.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str) -> DataFrame:
    """Sessions of a user that end after a gap."""
    s = events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("w.start").alias("session_start"), "n")
