"""Files in, snapshots on disk, quarantine, and small rules without SQL."""

import json

import pytest
from pyspark.sql import functions as F

from kgspark.functions import exprs
from kgspark.operators import parse, promotion, reads, store
from kgspark.streaming import outbox


def test_text_files(spark, tmp_path):
    (tmp_path / "a note+1.txt").write_text("first\nline", encoding="utf-8")
    (tmp_path / "blank.txt").write_text(" \n　", encoding="utf-8")
    (tmp_path / "b.txt").write_text("zweite Zeile ß", encoding="utf-8")
    rows = {r.title: r.content for r in store.text_files(spark, str(tmp_path)).collect()}
    assert rows == {"a note+1.txt": "first\nline", "b.txt": "zweite Zeile ß"}
    given = spark.createDataFrame([("x", None), ("y", " T "), (" ", "gone"), (None, "gone")], "content string, title string")
    assert {(r.title, r.content) for r in store.inline_texts(given).collect()} == {("Untitled", "x"), ("T", "y")}


def test_published_snapshots(spark, tmp_path):
    at = str(tmp_path / "store")
    one = {"a": spark.range(3), "b": spark.range(5)}
    store.publish(one, at)
    store.publish({"a": spark.range(4), "b": spark.range(5)}, at)
    now = store.current(spark, at, "a", "b")
    assert now["a"].count() == 4 and store.differing_counts(one, now) == ["a"]


def test_graph_json(spark):
    nodes = spark.createDataFrame([("a", "A"), ("b", "B")], "id string, name string")
    edges = spark.createDataFrame([("a", "b", "r")], "source_id string, target_id string, type string")
    got = json.loads(store.graph_json(nodes, edges, nodes.limit(0)).first()[0])
    assert got["stats"] == {"nodes": 2, "edges": 1, "statements": 0} and got["edges"][0]["target_id"] == "b"


def test_unknown_events_are_put_aside(spark, tmp_path):
    schema = "id long, aggregate_type string, aggregate_id string, event_type string"
    rows = [(1, "entity", "x", "upsert"), (2, "odd", "y", "upsert"), (3, None, "z", "upsert")]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    seen = []
    q = outbox.start(spark, str(tmp_path / "in"), schema, lambda df, _: seen.extend(r.id for r in df.collect()), str(tmp_path / "ck"), quarantine=str(tmp_path / "aside"))
    q.awaitTermination()
    aside = spark.read.parquet(str(tmp_path / "aside" / "*"))
    assert seen == [1] and {r.id for r in aside.collect()} == {2, 3} and aside.first().attempts == 1

    def fails(df, _):
        raise ValueError("x" * 900)

    outbox.start(spark, str(tmp_path / "in"), schema, fails, str(tmp_path / "ck2"), quarantine=str(tmp_path / "aside2")).awaitTermination()
    failed = spark.read.parquet(str(tmp_path / "aside2" / "failed-*"))
    assert failed.count() == 1 and len(failed.first().last_error) == 500
    twice = outbox.put_aside(spark.createDataFrame(rows[:1], schema), outbox.put_aside(spark.createDataFrame(rows[:1], schema), None, "a"), "b")
    assert [r.attempts for r in twice.collect()] == [2]


def test_running_sums(spark):
    sizes = [(k, list(range(k))) for k in (0, 1, 2, 255, 256, 257, 1000)]
    got = spark.createDataFrame(sizes, "k int, s array<bigint>").select("k", exprs.running(F.col("s")).alias("r")).collect()
    assert all(list(r.r) == [sum(range(i)) for i in range(r.k)] for r in got)


def test_many_lines_keep_their_places(spark):
    text = "\n".join(["# H", *[f"line {i}" for i in range(1500)], "## K", "last"])
    rows = parse.spans(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("order_index").collect()
    assert len(rows) == 1503 and all(text[r.char_start : r.char_start + len(r.raw)] == r.raw for r in rows)
    assert rows[700].heading_path == ["H"] and rows[-1].heading_path == ["H", "K"]


def test_questions():
    assert reads.question_list("q", [("user", "old"), ("assistant", "a"), ("user", "b"), ("user", "q"), ("assistant", "c")]) == ["q", "b"]
    assert reads.route("品牌是什么").brand == "" and reads.route("文档：a.b").document == "a.b"


def test_ancestors_of_a_cycle(spark):
    from kgspark.operators import graph

    with pytest.raises(ValueError):
        graph.ancestors(spark.createDataFrame([(1, 2), (2, 1)], "id long, parent long"))
    chain = graph.ancestors(spark.createDataFrame([(k, k + 1) for k in range(100)] + [(100, None), (7, 8)], "id long, parent long"))
    assert sorted(map(tuple, chain.collect())) == sorted((i, j, j - i) for i in range(101) for j in range(i + 1, 101))
    with pytest.raises(ValueError):
        graph.ancestors(spark.createDataFrame([(k, (k + 1) % 5) for k in range(5)] + [(9, 0)], "id long, parent long"))


def test_invalid_relation_groups(spark):
    rows = [("c1", "relation", "e", None, None, "o", 0.5, "d", 1), ("c2", "statement", "e", None, "t", None, 0.7, "d", 2), ("c3", "statement", "e", None, "t", None, 0.9, "d2", 3)]
    cols = "candidate_id string, candidate_type string, entity_id string, predicate string, label string, object_name string, confidence double, document_id string, published_at long"
    got = {r.candidate_type: r for r in promotion.fused_groups(spark.createDataFrame(rows, cols)).collect()}
    assert got["relation"].status == "invalid" and got["statement"].members == 2 and got["statement"].confidence == 0.9


PROPS = "struct<scalars: map<string,string>, source_document_id: string, source_document_ids: array<string>, aliases: array<string>, evidence_refs: array<string>>"


def merged_one_by_one(old, mentions):
    """Entities after mentions (id, name, type, properties) in order, by plain dictionaries."""
    out = {i: (n, t, p) for i, n, t, p in old}
    for i, name, kind, p in mentions:
        _, t, e = out.get(i, (None, kind, None))
        e = e or {"scalars": {}, "source_document_id": None, "source_document_ids": [], "aliases": [], "evidence_refs": []}
        uniq = lambda *xs: list(dict.fromkeys(x for v in xs for x in (v or [])))
        src = [x for x in uniq(e["source_document_ids"], [e["source_document_id"]], p["source_document_ids"], [p["source_document_id"]]) if x]
        out[i] = (name, t, {"scalars": {**(e["scalars"] or {}), **(p["scalars"] or {})}, "source_document_id": src[0] if src else None, "source_document_ids": src, "aliases": uniq(e["aliases"], p["aliases"]), "evidence_refs": uniq(e["evidence_refs"], p["evidence_refs"])})
    return out


def test_fold_of_many_documents_equals_one_by_one(spark):
    import random

    rnd = random.Random(2)
    some = lambda xs: rnd.choice([None, [], rnd.sample(xs, rnd.randint(1, 3))])
    props = lambda: {"scalars": rnd.choice([None, {rnd.choice("ab"): rnd.choice("xyz")}, {"a": "1", "b": "2"}]), "source_document_id": rnd.choice([None, "", "d1", "d2", "d3"]), "source_document_ids": some(["d2", "d4", "d5"]), "aliases": some(list("pqrs")), "evidence_refs": some(list("uvw"))}
    old = [(f"e{k}", f"old{k}", "t", props()) for k in range(6)]
    mentions = [(f"e{rnd.randrange(3, 12)}", f"m{k}", f"kind{k}", props()) for k in range(80)]
    cols = f"id string, name string, type string, properties {PROPS}"
    rows = [(*m, k // 4, k % 4) for k, m in enumerate(mentions)]
    rnd.shuffle(rows)
    got = store.fold_entities(spark.createDataFrame(old, cols), spark.createDataFrame(rows, cols + ", doc int, seq int"), ["doc", "seq"])
    assert {r.id: (r.name, r.type, r.properties.asDict(True)) for r in got.collect()} == merged_one_by_one(old, mentions)
    none = spark.createDataFrame([], cols + ", doc int, seq int")
    assert sorted(map(str, store.fold_entities(got, none, ["doc", "seq"]).collect())) == sorted(map(str, got.collect()))


def test_bundle_of_two_documents_that_mention_one_entity(spark):
    cols = f"id string, name string, properties {PROPS}"
    p = lambda d: {"scalars": {"k": d}, "source_document_id": d, "source_document_ids": None, "aliases": None, "evidence_refs": None}
    rel = "id string, document_id string, source_id string, confidence double, ord int"
    held = {
        "documents": spark.createDataFrame([("d9", "t", 1)], "document_id string, title string, created_at int"), "entities": spark.createDataFrame([], cols),
        "relations": spark.createDataFrame([("r1", "d9", "a", 0.1)], rel.replace(", ord int", "")), "outbox": spark.createDataFrame([], "aggregate_type string, aggregate_id string, event_type string, processed boolean"),
    }
    bundle = {
        "documents": spark.createDataFrame([("d1", "t", 1), ("d2", "t", 1)], "document_id string, title string, created_at int"), "entities": spark.createDataFrame([("e1", "A", p("d1"), 1), ("e1", "B", p("d2"), 2)], cols + ", ord int"),
        "relations": spark.createDataFrame([("r1", "d1", "b", 0.5, 1), ("r2", "d1", "b", 0.6, 1), ("r2", "d2", "c", 0.7, 2)], rel),
    }
    out = store.replace_bundle(held, bundle)
    (e,) = out["entities"].collect()
    assert e.name == "B" and e.properties.source_document_ids == ["d1", "d2"] and e.properties.scalars == {"k": "d2"}
    assert sorted(map(tuple, out["relations"].select("id", "document_id", "source_id", "confidence").collect())) == [("r1", "d9", "a", 0.5), ("r2", "d1", "b", 0.7)]
    assert sorted((r.aggregate_type, r.aggregate_id) for r in out["outbox"].collect()) == [("entity", "e1"), ("relation", "r1"), ("relation", "r2")]
