"""Governance, keyed writes, payloads and registries on hand-made rows."""

import json
import uuid
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from kgspark.functions.exprs import uuid5_url
from kgspark.operators import governance, payloads, upsert
from kgspark.sources import registry


def test_chains(spark):
    rows = [(1, None), (2, 1), (3, 2), (4, 3), (5, 4), (6, 99), (7, 7), (8, 9), (9, 8), (10, 8), (11, 12), (12, 13), (13, 11)]
    got = {r["id"]: (r["root"], r["depth"]) for r in governance.chains(spark.createDataFrame(rows, "id long, prev long"), "id", "prev").collect()}
    assert got == {1: (1, 0), 2: (1, 1), 3: (1, 2), 4: (1, 3), 5: (1, 4), 6: (6, 0), **{i: (None, None) for i in range(7, 14)}}


def test_chains_of_nothing(spark):
    assert governance.chains(spark.createDataFrame([], "id long, prev long"), "id", "prev").collect() == []


def test_near_duplicates_equal_brute_force(spark):
    texts = ["the market grew by ten percent", "The market  grew by ten percent!", "the market grew by two percent", "nothing alike at all", "", None, "naïve 市场 growth", "naive 市场 growth", "a", "b" * 300, "b" * 290]
    df = spark.createDataFrame([(str(i), t, i) for i, t in enumerate(texts)], "id string, text string, at int")
    got = {(r["id"], r["duplicate_of"]) for r in governance.near_duplicates(df, df, "id", "text", "at").collect()}
    tidy = [" ".join((t or "").lower().split()) for t in texts]
    want = set()
    for i, t in enumerate(tidy):
        hits = [j for j, o in reversed(list(enumerate(tidy))) if j != i and t and o and SequenceMatcher(None, t, o).ratio() >= 0.85]
        want |= {(str(i), str(hits[0]))} if hits else set()
    assert got == want and want


def test_overlaps_with_open_ends(spark):
    df = spark.createDataFrame([("k", 1, "a", 1, 5), ("k", 2, "b", 5, None), ("k", 3, "a", 9, 9), ("k", 4, "b", 6, 7), ("j", 5, "c", 1, 9)], "key string, id int, v string, s int, e int")
    got = {(r["first_id"], r["second_id"]) for r in governance.overlaps(df, ["key"], "id", "v", "s", "e").collect()}
    assert got == {(1, 2), (2, 3)}


def test_queue_keeps_what_is_not_pending(spark):
    old = spark.createDataFrame([("t", "1", "r", "x", 1, "old", "pending"), ("t", "2", "r", "x", 1, "old", "done")], "target_type string, target_id string, review_type string, tenant_id string, priority int, reason string, status string")
    new = spark.createDataFrame([("t", "1", "r", "y", 8, "a", 1), ("t", "1", "r", "y", 9, "b", 2), ("t", "2", "r", "y", 8, None, 1)], "target_type string, target_id string, review_type string, tenant_id string, priority int, reason string, ord int")
    got = {(r["target_id"], r["tenant_id"], r["priority"], r["reason"], r["status"]) for r in upsert.queue_reviews(old, new, "ord").collect()}
    assert got == {("1", "x", 9, "b", "pending"), ("2", "x", 1, "old", "done"), ("2", "y", 8, None, "pending")}


def test_refresh_and_reuse(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", None)], "id int, p string, q string")
    new = spark.createDataFrame([(1, None, "y"), (3, "c", "z")], "id int, p string, q string")
    assert {tuple(r) for r in upsert.refreshed(old, new, "id").collect()} == {(1, "a", "y"), (2, "b", None), (3, "c", "z")}
    assert [tuple(r) for r in upsert.reused(old, spark.createDataFrame([(9, "b", None), (9, "n", None)], "id int, p string, q string"), ["p", "q"]).collect()] == [(9, "n", None)]


def test_folded_payloads(spark):
    def answer(**x):
        return "Here:\n```json\n" + json.dumps(x, ensure_ascii=False) + "\n```"

    good = answer(
        entities=[{"entity_type": "brand", "name": "Nord  Works"}, {"id": "e7", "type": "product", "canonical_name": "Kite"}, {"name": ""}],
        relations=[
            {"subject": "nord works", "relation": "offers", "object": "e7"},
            {"subject": {"name": "Nord Works", "type": "organization"}, "type": "offers", "object": {"entity_id": "e7"}},
            {"subject": "Nobody", "relation": "offers", "object": "Kite", "entity_type_subject": "brand"},
        ],
        statements=[{"text": "s", "confidence": 0.5}],
    )
    rows = [(1, good), (2, answer(entities={"a": 1})), (3, answer(relations=["x"])), (4, "no object"), (5, None), (6, answer())]
    got = {r["id"]: r for r in payloads.folded(spark.createDataFrame(rows, "id int, answer string"), "answer").collect()}
    assert [(e["id"], e["type"], e["name"]) for e in got[1]["entities"]] == [("llm-entity-0", "brand", "Nord  Works"), ("e7", "product", "Kite"), (None, None, None)]
    assert [tuple(r)[:5] for r in got[1]["relations"]] == [
        ("llm-entity-0", "brand", "offers", "e7", "product"), ("llm-entity-0", "organization", "offers", "e7", "product"), ("Nobody", "brand", "offers", "e7", "product"),
    ]
    assert got[1]["statements"][0]["text"] == "s" and got[1]["error"] is None
    assert [got[i]["error"] for i in (2, 3, 4, 5, 6)] == ["entities must be an array", "relations must contain objects", "not JSON", "not JSON", None]
    assert got[6]["entities"] == [] and got[2]["entities"] is None


def test_registry(spark, tmp_path):
    (tmp_path / "a.yaml").write_text("entities:\n- {code: brand, name: Brand}\n- {code: brand}\nrelations:\n- {code: offers, domain: [brand], range: [product]}\nversion: 1\n")
    (tmp_path / "b.yaml").write_text("[]\n")
    reg = registry.load(spark, str(tmp_path))
    assert [r["code"] for r in reg.collect()] == ["brand", "brand", "offers"]
    assert {tuple(r) for r in registry.faults(reg).collect()} == {("repeated code", "brand", "entities"), ("unknown range", "offers", "product")}


def test_uuid5(spark):
    names = ["", "https://example.com/é", "gate:1", "gate:2", "x" * 200]
    got = spark.createDataFrame([(n,) for n in names], "n string").select(uuid5_url("n").alias("u")).collect()
    assert [r["u"] for r in got] == [str(uuid.uuid5(uuid.NAMESPACE_URL, n)) for n in names]


def test_missing_score_is_no_review(spark):
    row = spark.range(1).select(*[F.lit(3).alias(c) for c in list(governance.SOURCE_WEIGHTS)[:-1]], F.lit(None).cast("int").alias("transparency"))
    assert governance.source_quality(row).select("score", "needs_review").first() == (None, None)


def test_types_of_sources_are_bits(spark):
    from kgspark.operators import rule_tables

    rows = spark.createDataFrame([(1, "b"), (2, "b"), (3, "b")], "id int, brand_id string")
    refs = spark.createDataFrame([(1, "s1"), (1, "s2"), (2, "s3"), (2, "s1"), (2, "s1")], "id int, source_id string")
    sources = spark.createDataFrame([("s1", "official", "b", "u", 1), ("s2", "odd", "c", None, 9), ("s3", None, "c", None, None)], "source_id string, source_type string, brand_id string, url string, observed_day int")
    got = rule_tables.with_sources(rows, refs, sources)
    assert {r.id: (r.n_sources, r.types, r.n_own) for r in got.collect()} == {1: (2, 1 | 1 << len(rule_tables.TYPES), 1), 2: (2, 1, 1), 3: (0, 0, 0)}
    assert "ObjectHashAggregate" not in got._jdf.queryExecution().toString()


def test_versions_are_read_once_and_long_chains_settle(spark):
    rows = [(k, k - 1 if k else None, "s", "p") for k in range(100)] + [(200, 202, "s", "p"), (201, 200, "s", "p"), (202, 201, "s", "p"), (203, 202, "s", "p"), (300, 999, "s", "p"), (301, 99, "t", "p"), (302, 99, "s", "p")]
    got = governance.chain_errors(spark.createDataFrame(rows, "id long, supersedes_id long, subject_id string, predicate string"))
    want = {*((k, "cycle") for k in (200, 201, 202, 203)), *((k, "fork") for k in (200, 203, 301, 302)), (300, "unknown"), (301, "other_subject")}
    assert set(map(tuple, got.collect())) == want and got.count() == len(want)
    assert "Join" not in got._jdf.queryExecution().toString()  # a written result, not one that reads the versions again
