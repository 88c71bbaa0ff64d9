"""Calls of models (extraction, embedding, entity recognition) as a Spark job: batches with retries, failure rows, results kept by what was asked."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from kgspark.session import materialise, workers_import_this

#: A client takes the texts of a batch and gives items {"index": place in the batch, "payload": anything JSON can say}, in any order; it may raise.
Client = Callable[[list[str]], list[dict[str, Any]]]
RESULT = "unit_hash string, ok boolean, payload string, attempts int, error string"
ERROR_LENGTH = 500

# fixed values: labels of a recogniser with the entity types they stand for; others are dropped
NER_TYPES = {
    "organization": "organization", "org": "organization", "company": "organization", "product": "product", "product_name": "product", "capability": "capability", "function": "capability",
    "feature": "capability", "certification": "certification", "cert": "certification", "audience": "audience", "customer": "customer", "person": "customer",
}


def unit_hash(model: str, text: Column) -> Column:
    """What a result is kept under: the model's name and the text."""
    return F.sha2(F.concat(F.lit(model), F.lit("\x1f"), text), 256)


def answers(client: Client, texts: list[str], tries: int) -> tuple[list[Any], int, str | None]:
    """(payloads in the texts' order, attempts, last error): payloads are None where the client gave none for an index or never answered."""
    error = None
    for attempt in range(1, tries + 1):
        try:
            got = {int(x["index"]): x.get("payload") for x in client(texts)}
        except Exception as e:  # whatever a client raises, the batch may be tried again
            error = f"{type(e).__name__}: {e}"[:ERROR_LENGTH]
        else:
            return [got.get(k) for k in range(len(texts))], attempt, None
    return [None] * len(texts), tries, error


def called(units: DataFrame, key: str, text: str, connect: Callable[[], Client], model: str, known: DataFrame | None = None, batch: int = 32, tries: int = 3, tasks: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(results, kept): results has key, unit_hash, ok, payload (JSON), attempts, error for each row of units; kept (RESULT) is what to give as `known` next time.

    Equal texts are asked once, texts that `known` has a good result for not at all, so running it again asks for what is new or failed. connect() is called once a task.
    A batch that fails `tries` times is asked text by text, so one bad text costs only itself; a text without an answer is a row with ok false, never a failed job.
    Null and blank texts are not asked (ok false, no error). tasks bounds the calls at a time.
    """
    workers_import_this(units.sparkSession)
    rows = units.select(F.col(key), F.when(F.trim(F.col(text)) != "", F.col(text)).alias("kg_text")).withColumn("unit_hash", unit_hash(model, F.col("kg_text")))
    todo = rows.where("kg_text is not null").groupBy("unit_hash").agg(F.first("kg_text").alias("text"))
    good = known.where("ok") if known is not None else None
    if good is not None:
        todo = todo.join(good.select("unit_hash"), "unit_hash", "left_anti")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = connect()
        for frame in frames:
            for lo in range(0, len(frame), batch):
                hashes, texts = (frame[c].iloc[lo : lo + batch].tolist() for c in ("unit_hash", "text"))
                got, attempts, error = answers(client, texts, tries)
                out = [(h, p is not None, p, attempts, error) for h, p in zip(hashes, got)]
                if error is not None and len(texts) > 1:
                    out = []
                    for h, t in zip(hashes, texts):
                        (p,), more, e = answers(client, [t], 1)
                        out.append((h, p is not None, p, attempts + more, e))
                yield pd.DataFrame(
                    {
                        "unit_hash": pd.Series([o[0] for o in out], dtype=object), "ok": pd.Series([o[1] for o in out], dtype=bool), "payload": pd.Series([None if o[2] is None else json.dumps(o[2], ensure_ascii=False, sort_keys=True) for o in out], dtype=object),
                        "attempts": pd.Series([o[3] for o in out], dtype="int32"), "error": pd.Series([o[4] if o[1] else o[4] or "no answer" for o in out], dtype=object),
                    }
                )

    fresh = (todo.repartition(tasks) if tasks else todo).mapInPandas(run, RESULT)
    kept = materialise(fresh if good is None else good.select("unit_hash", "ok", "payload", "attempts", "error").unionByName(fresh), "model-results")
    results = rows.drop("kg_text").join(kept, "unit_hash", "left").select(key, "unit_hash", F.coalesce("ok", F.lit(False)).alias("ok"), "payload", F.coalesce("attempts", F.lit(0)).alias("attempts"), "error")
    return results, kept


def recognised(results: DataFrame, key: str) -> DataFrame:
    """Entity candidates (key, name, entity_type, confidence, generator) of a recogniser's results, payload [{text, type, score}]: labels of NER_TYPES, score to three places (0.7 where none is given). Failed units give none."""
    found = results.where("ok").select(key, F.explode(F.from_json("payload", "array<struct<text: string, type: string, score: double>>")).alias("e"))
    kind = F.try_element_at(F.create_map(*[F.lit(x) for pair in NER_TYPES.items() for x in pair]), F.lower("e.type"))
    rows = found.select(key, F.col("e.text").alias("name"), kind.alias("entity_type"), F.round(F.coalesce("e.score", F.lit(0.7)), 3).alias("confidence"))
    return rows.where("entity_type is not null and name <> ''").withColumn("generator", F.concat(F.lit("ner:"), F.col("entity_type")))


def with_fallback(results: DataFrame, candidates: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """candidates (key, generator, ...) of units whose call gave some, and for the others those of rules, with their generator marked `fallback:`."""
    answered = candidates.select(key).distinct().join(results.where("ok").select(key).distinct(), key, "left_semi")
    rest = rules.join(answered, key, "left_anti").withColumn("generator", F.concat(F.lit("fallback:"), F.coalesce("generator", F.lit("rule"))))
    return candidates.join(answered, key, "left_semi").unionByName(rest.select(*candidates.columns))
