"""The outbox as a stream with retries: keyed state holds what was applied, what waits for its next try, and tombstones.

Each aggregate has a key. Its state is the newest version applied (a deleted
aggregate's stays as a tombstone, so an older upsert can't bring it back) and the events whose
application failed, with attempts, last error and the time of the next try,
for which a timer is set. What comes out is a log of outcomes; the graph is
read off the log by projection(), in which the order of arrival has no say.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Aggregates that become vertices, with their labels, and those whose payload names ends.
LABELS = {"entity": "Entity", "statement": "Assertion", "assertion": "Assertion", "evidence": "Evidence", "source": "Source", "report": "Report"}
KNOWN = (*LABELS, "relation")
#: Columns of an event; payload fields that its kind has no use for are null. subject_id and object_id are a relation's or an assertion's ends.
FIELDS = ("id", "aggregate_type", "aggregate_id", "event_type", "created_at", "subject_id", "object_id", "name")
EVENT = "id long, aggregate_type string, aggregate_id string, event_type string, created_at long, subject_id string, object_id string, name string"
OUTCOME = EVENT + ", status string, attempts int, last_error string"
ERROR_LENGTH = 500
EMPTY_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"
RETRIES = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

Apply = Callable[[dict], None]


class Retrying(StatefulProcessor):
    """Applies the events of an aggregate; a failed one is tried again after first_wait_ms, and after twice the last wait from then on, until `most` attempts are spent.

    Outcomes: applied; stale (an older event than the one applied last: not applied, but no longer pending); dead (attempts spent, with the
    last error). An event that waits has no outcome yet. The same event again changes nothing. Retries run in the order of events.
    """

    def __init__(self, apply: Apply, most: int = 5, first_wait_ms: int = 1000, tries_now: int = 1) -> None:
        self.apply, self.most, self.first_wait_ms, self.tries_now = apply, most, first_wait_ms, tries_now

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.version = handle.getValueState("version", "created_at long, id long, event_type string")
        self.waiting = handle.getMapState("waiting", "id long", OUTCOME + ", next_ms long")

    def _begin(self) -> None:
        """Read a key's version once; events of the key then meet it here, and _end() writes it back."""
        self.seen = tuple(self.version.get()) if self.version.exists() else None
        self.changed = False

    def _end(self) -> None:
        if self.changed:
            self.version.update(self.seen)

    def _tried(self, event: dict, now: int) -> dict | None:
        """The outcome of one more round of attempts, or None where the event waits."""
        if self.seen is not None and (event["created_at"], event["id"]) <= self.seen[:2]:
            return {**event, "status": "stale"}
        for _ in range(self.tries_now):
            event["attempts"] += 1
            try:
                self.apply({k: event[k] for k in FIELDS} | {"attempt": event["attempts"]})
            except Exception as e:  # whatever the target raises is the event's last error
                event["last_error"] = f"{type(e).__name__}: {e}"[:ERROR_LENGTH]
            else:
                self.seen, self.changed = (event["created_at"], event["id"], event["event_type"]), True
                return {**event, "status": "applied"}
            if event["attempts"] >= self.most:
                return {**event, "status": "dead"}
        wait = self.first_wait_ms * 2 ** (event["attempts"] - 1)
        self.waiting.updateValue((event["id"],), (*(event[k] for k in FIELDS), "waiting", event["attempts"], event["last_error"], now + wait))
        self.handle.registerTimer(now + wait)
        return None

    def _frame(self, rows: list[dict]) -> Iterator[pd.DataFrame]:
        if rows:
            names = [*FIELDS, "status", "attempts", "last_error"]
            yield pd.DataFrame({n: pd.Series([r[n] for r in rows], dtype="int64" if n in ("id", "created_at") else "int32" if n == "attempts" else object) for n in names})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        self._begin()
        some, mine = self.waiting.exists(), set()  # whether anything waits from before, and what waits since
        for batch in rows:
            events = sorted(batch.astype(object).where(batch.notna(), None).to_dict("records"), key=lambda e: (e["created_at"], e["id"]))
            out = []
            for e in events:
                if e["id"] in mine or (some and self.waiting.containsKey((e["id"],))):
                    continue  # it came again while it waits
                got = self._tried({**{k: e[k] for k in FIELDS}, "attempts": 0, "last_error": None}, now)
                if got:
                    out.append(got)
                else:
                    mine.add(e["id"])
            yield from self._frame(out)
        self._end()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        due = []
        for _, v in self.waiting.iterator():
            row = dict(zip([*FIELDS, "status", "attempts", "last_error", "next_ms"], v))
            if row.pop("next_ms") <= now:
                due.append(row)
        out = []
        self._begin()
        for event in sorted(due, key=lambda e: (e["created_at"], e["id"])):
            self.waiting.removeKey((event["id"],))
            got = self._tried(event, now)
            if got:
                out.append(got)
        self._end()
        yield from self._frame(out)

    def close(self) -> None:
        pass


@contextmanager
def _by_value(*modules: str) -> Iterator[None]:
    """Ship these modules' functions with the query: its workers need not be able to import them."""
    found = [m for m in dict.fromkeys(modules) if m in sys.modules and m != "__main__" and m not in cloudpickle.list_registry_pickle_by_value()]
    for m in found:
        cloudpickle.register_pickle_by_value(sys.modules[m])
    try:
        yield
    finally:
        for m in found:
            cloudpickle.unregister_pickle_by_value(sys.modules[m])


def start(spark: SparkSession, path: str, log: str, checkpoint: str, apply: Apply, wait: str | None = None, most: int = 5, first_wait_ms: int = 1000, tries_now: int = 1) -> StreamingQuery:
    """Stream event files (EVENT) of a folder through Retrying; outcomes go to `log`, one folder a batch, which a repeated batch overwrites.

    Without `wait` (a trigger's interval) the query ends when it has read what there is; events that wait then have their next try
    when a query with the same checkpoint meets new events. With `wait`, timers run batches of their own once the query has had its first. Events of unknown aggregates, and those without id, aggregate or time, get the outcome `unknown` and are not applied.
    The session's state store has to be ROCKS (RETRIES names the setting).
    """
    if spark.conf.get(RETRIES, "") != ROCKS:
        raise ValueError(f"set {RETRIES} to {ROCKS}")
    events = spark.readStream.schema(EVENT).parquet(path)
    good = F.coalesce(F.col("aggregate_type").isin(*KNOWN), F.lit(False)) & F.col("id").isNotNull() & F.col("aggregate_id").isNotNull() & F.col("created_at").isNotNull()
    with _by_value(__name__, apply.__module__):
        tried = events.where(good).groupBy("aggregate_type", "aggregate_id").transformWithStateInPandas(Retrying(apply, most, first_wait_ms, tries_now), OUTCOME, "Append", "ProcessingTime")
        tried.schema  # the function is pickled here, while its modules go by value
    odd = events.where(~good).withColumns({"status": F.lit("unknown"), "attempts": F.lit(0), "last_error": F.lit("unknown aggregate or missing value")})
    writer = tried.unionByName(odd).writeStream.outputMode("append").option("checkpointLocation", checkpoint)
    writer = writer.foreachBatch(lambda rows, number: rows.write.mode("overwrite").parquet(f"{log}/batch={number}"))
    if wait:
        return writer.trigger(processingTime=wait).start()
    # timers ask for one batch after another; without batches that have no data the query can end
    before = spark.conf.get(EMPTY_BATCHES)
    spark.conf.set(EMPTY_BATCHES, "false")
    try:
        return writer.trigger(availableNow=True).start()
    finally:
        spark.conf.set(EMPTY_BATCHES, before)


def outcomes(spark: SparkSession, log: str) -> DataFrame:
    """The log's rows, each event's once (an event that was replayed after its outcome comes out again as stale; the first outcome counts)."""
    rows = spark.read.schema(OUTCOME + ", batch long").parquet(log)
    rest = [c for c in rows.columns if c not in ("id", "batch")]
    return rows.groupBy("id").agg(F.min_by(F.struct(*rest), F.struct("batch", F.when(F.col("status") == "stale", 1).otherwise(0))).alias("o")).select("id", "o.*")


def projection(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices (label, id, name) and edges (id, source_id, target_id, relation_type) after events, whatever order they came in and however often.

    The last event of an aggregate by (created_at, id) decides: an upsert shows it, a delete drops it. An edge, or an assertion's SUBJECT or OBJECT link, is held
    until both ends are there; a delete of an end detaches the edges that are older than it, also where the end comes back. Dead and unknown outcomes
    have no effect (events without a status all count).
    """
    if "status" in events.columns:
        events = events.where(F.col("status").isin("applied", "stale"))
    at = F.struct("created_at", "id")
    kept = F.struct("event_type", "subject_id", "object_id", "name", at.alias("at"))
    label = reduce(lambda c, kv: c.when(F.col("aggregate_type") == kv[0], kv[1]), LABELS.items(), F.when(F.lit(False), F.lit("")))
    known = events.where(F.col("aggregate_type").isin(*KNOWN))
    keys = [F.coalesce(label, F.lit("")).alias("label"), F.col("aggregate_id")]
    last = known.groupBy(*keys).agg(F.max_by(kept, at).alias("l"), F.max(F.when(F.col("event_type") == "delete", at)).alias("gone")).select("label", "aggregate_id", "l.*", "gone")
    shown = last.where("event_type <> 'delete'")
    vertices = shown.where("label <> ''").select("label", F.col("aggregate_id").alias("id"), "name")
    link = lambda c, kind: shown.where((F.col("label") == "Assertion") & F.col(c).isNotNull()).select(F.lit(None).cast("string").alias("id"), F.col("aggregate_id").alias("source_id"), F.col(c).alias("target_id"), F.lit(kind).alias("relation_type"), "at", F.lit("Assertion").alias("from"))
    edges = shown.where("label = ''").select(F.col("aggregate_id").alias("id"), F.col("subject_id").alias("source_id"), F.col("object_id").alias("target_id"), F.coalesce("name", F.lit("RELATED_TO")).alias("relation_type"), "at", F.lit("Entity").alias("from"))
    edges = edges.unionByName(link("subject_id", "SUBJECT")).unionByName(link("object_id", "OBJECT"))
    ends = shown.where("label in ('Entity', 'Assertion')").select("label", "aggregate_id", "gone")

    def held(rows: DataFrame, end: str, label_: Column) -> DataFrame:
        e = ends.select(F.col("label").alias("kg_label"), F.col("aggregate_id").alias("kg_id"), F.col("gone").alias("kg_gone"))
        return rows.join(e, (F.col(end) == F.col("kg_id")) & (label_ == F.col("kg_label"))).where("kg_gone is null or kg_gone < at").drop("kg_label", "kg_id", "kg_gone")

    edges = held(held(edges, "source_id", F.col("from")), "target_id", F.lit("Entity"))
    return vertices, edges.select("id", "source_id", "target_id", "relation_type")
