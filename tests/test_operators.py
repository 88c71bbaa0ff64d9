"""Parsing, extraction, fusion, gates, graph and streaming on hand-made rows."""

import hashlib

from pyspark.sql import functions as F

from kgspark.functions import exprs
from kgspark.operators import extract, gates, graph, parse, promotion, retrieve, templates
from kgspark.streaming import outbox as stream

TEXT = "# Top\nFirst line here.\n\n### Deep\n- an item\n1. second\n## Next ##\nlast words"


def docs(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def test_spans_headings_and_offsets(spark):
    rows = parse.spans(docs(spark, TEXT, None, "", " \n ")).orderBy("doc_id", "order_index").collect()
    assert [(r.span_id, r.span_type, r.text) for r in rows] == [
        ("ES_00000", "heading", "Top"), ("ES_00001", "paragraph", "First line here."), ("ES_00002", "heading", "Deep"), ("ES_00003", "list_item", "an item"),
        ("ES_00004", "list_item", "second"), ("ES_00005", "heading", "Next"), ("ES_00006", "paragraph", "last words"),
    ]
    assert [r.heading_path for r in rows] == [["Top"], ["Top"], ["Top", "Deep"], ["Top", "Deep"], ["Top", "Deep"], ["Top", "Next"], ["Top", "Next"]]
    assert all(TEXT[r.char_start :].startswith(r.raw) for r in rows)


def test_units_break_at_headings_and_tokens(spark):
    rows = parse.units(docs(spark, TEXT, "\n".join(["word " * 70] * 4))).orderBy("doc_id", "unit_no").collect()
    assert [r.source_span_ids for r in rows if r.doc_id == 0] == [["ES_00000", "ES_00001"], ["ES_00002", "ES_00003", "ES_00004"], ["ES_00005", "ES_00006"]]
    assert [r.merge_reason for r in rows if r.doc_id == 0] == [["same_heading"], ["same_heading", "list_context"], ["same_heading"]]
    assert [len(r.source_span_ids) for r in rows if r.doc_id == 1] == [2, 2]


def test_statements_once_each(spark):
    rows = parse.statements(docs(spark, "a long enough line\nshort\na long enough line\nanother good line")).orderBy("order_index").collect()
    assert [(r.statement_text, r.order_index) for r in rows] == [("a long enough line", 0), ("another good line", 3)]


def test_rules_and_mentions(spark):
    text = "某某科技公司提供 CRM 平台，支持客户管理、销售分析，面向中小企业。增长 20%，版本 V1.2.3，通过 ISO 27001，见 https://a.example/x。"
    u = docs(spark, text).withColumn("unit_id", F.lit("EU_00000"))
    kinds = {(r.kind, r.value) for r in extract.candidates(u).collect()}
    assert {("metric", "20%"), ("version", "V1.2.3"), ("certification", "ISO 27001"), ("url", "https://a.example/x")} <= kinds
    found = extract.mentions(u, ["brand", "organization", "product", "capability", "audience"], F.lit("Acme"))
    got = {(r.entity_type, r.name) for r in found.collect()}
    assert ("brand", "Acme") in got and ("product", "CRM 平台") in got and any(t == "audience" for t, _ in got)
    rel = {(r.relation, r.subject, r.object) for r in extract.relations(found, ["offers", "has_capability", "serves"]).collect()}
    assert ("offers", "Acme", "CRM 平台") in rel


def test_names_and_ids(spark):
    r = docs(spark, "x").select(
        exprs.stable_id("p", F.lit("a"), F.lit(None), F.lit("b")).alias("i"), exprs.normalize_name(F.lit(" A b，c:d ")).alias("n"), exprs.normalized_name(F.lit("  A　 b ")).alias("m"),
        exprs.slug(F.lit("Ab c-1")).alias("s"), exprs.mime_type(F.lit("x.MD")).alias("t"), exprs.token_estimate(F.lit("中文字 abc 12")).alias("k"), exprs.metric_number(F.lit("-1.5")).alias("v"),
    ).first()
    assert r.i == "p_" + hashlib.sha256("a\u001f\u001fb".encode()).hexdigest()[:20]
    assert (r.n, r.m, r.s, r.t, r.k, r.v) == ("abcd", "a b", "abc1", "text/markdown", 3, -1.5)


def test_gates_review_beats_reject(spark):
    rows = spark.createDataFrame([(1, True, True, 1, False, False, "0.750"), (2, False, True, 1, True, False, "0.9"), (3, False, True, 1, False, False, "0.9"), (4, None, None, None, None, None, None)], "id int, schema_valid boolean, type_known boolean, evidence_count int, is_duplicate boolean, has_conflict boolean, confidence string")
    got = {r.id: r.d for r in gates.gates(rows).select("id", gates.disposition().alias("d")).collect()}
    assert got == {1: "promote", 2: "review", 3: "reject", 4: "review"}


def test_fuse_keeps_first_and_orders(spark):
    rows = spark.createDataFrame([("k", 2, "b", 0.9, "m2", "r1"), ("k", 1, "a", None, "m1", "r2"), ("k", 3, "c", 0.1, "m1", "r1")], "key string, o int, name string, confidence double, method string, ref string")
    r = gates.fuse(rows, "key", ["o"], "ref", "method", ["name"]).first()
    assert (r.name, r.confidence, r.methods, r.refs) == ("a", 0.9, ["m1", "m2"], ["r2", "r1"])


def test_document_replace_and_merge(spark):
    old = spark.createDataFrame([("d1", 1), ("d2", 2)], "document_id string, x int")
    new = spark.createDataFrame([("d1", 9)], "document_id string, x int")
    got = sorted(map(tuple, graph.replace_documents(old, new, new).collect()))
    assert got == [("d1", 9), ("d2", 2)]
    assert sorted(map(tuple, graph.replace_documents(graph.replace_documents(old, new, new), new, new).collect())) == got


def test_outbox_apply_is_idempotent(spark):
    v = spark.createDataFrame([("a", "A"), ("b", "B")], "id string, name string")
    ev = spark.createDataFrame([("a", "delete", 2, 2), ("a", "upsert", 1, 1), ("c", "upsert", 1, 3)], "aggregate_id string, event_type string, created_at int, id int")
    payload = spark.createDataFrame([("a", "A2"), ("c", "C")], "id string, name string")
    once = stream.apply(v, ev, payload)
    assert sorted(map(tuple, once.collect())) == [("b", "B"), ("c", "C")]
    assert sorted(map(tuple, stream.apply(once, ev, payload).collect())) == [("b", "B"), ("c", "C")]


def test_stream_batches(spark, tmp_path):
    rows = [(1, "entity", "a", "upsert"), (1, "entity", "a", "upsert"), (2, "unknown", "b", "upsert")]
    schema = "id long, aggregate_type string, aggregate_id string, event_type string"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    seen = []
    q = stream.start(spark, str(tmp_path / "in"), schema, lambda df, n: seen.extend(df.collect()), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert [(r.id, r.aggregate_id) for r in seen] == [(1, "a")]


def test_intent():
    i = retrieve.intent("这个 品牌 的产品有哪些？")
    assert i.brand and "product" in i.types and not i.overview


def test_nearest_runs_more_queries_than_a_block_holds(spark):
    v = spark.range(60).select(F.col("id").alias("vec_id"), F.array(F.sin("id"), F.cos("id"), F.sin(F.col("id") * 3)).alias("embedding"))
    got = lambda n: sorted(map(tuple, retrieve.nearest(v, v.where("vec_id % 2 = 0"), 3, n).collect()))
    assert got(7) == got(29) == got(30) and len(got(7)) == 90


def test_nearest_with_zero_null_and_equal_vectors(spark):
    """Zero vectors have similarity NaN, which is greatest; null and odd ones have none; equal ones stand by their ids."""
    rows = [(0, [1.0, 0.0]), (9, [2.0, 0.0]), (5, [3.0, 0.0]), (7, [0.0, 0.0]), (3, None), (4, [1.0]), (6, [1.0, None])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [(r.vec_id, None if r.similarity is None else str(r.similarity), r.k) for r in retrieve.nearest(v, v.where("vec_id = 0"), 5).orderBy("k").collect()]
    assert got == [(7, "nan", 1), (5, "1.0", 2), (9, "1.0", 3), (3, None, 4), (4, None, 5)]
    assert [r.vec_id for r in retrieve.nearest(v, v.where("vec_id = 3"), 2).orderBy("k").collect()] == [0, 4]


def test_ontology_gate_sends_objects_that_many_rows_name_to_the_rows(spark):
    ids = [("p", "product"), ("m", "regional_market"), ("x", "strange")]
    rules = spark.createDataFrame([("active_in", "product", "regional_market")], "relation_type string, source_type string, target_type string")
    kinds = ("relation", "metric")
    rows = [(k, s, o, kind, p) for k, (s, o, kind, p) in enumerate((s, o, kind, p) for s in ("p", "m", "x", "none", None) for o in ("m", "p", "x", "none", None) for kind in kinds for p in ("active_in", "other", None))]
    df = spark.createDataFrame(rows, "id long, subject_id string, object_id string, knowledge_type string, predicate string")
    out = promotion.ontology_gate(df, spark.createDataFrame(ids, "id string, type string"), ["product", "regional_market"], rules)
    of = dict(ids)

    def passes(s, o, kind, p):
        if "x" in (s, o):
            return False
        return kind != "relation" or None in (s, o, p) or (p, of.get(s), of.get(o)) == ("active_in", "product", "regional_market")

    assert {r.id: r.gate_ontology for r in out.collect()} == {k: passes(*rest) for k, *rest in rows}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftSemi, (object_id" in plan and "Join LeftAnti, (object_id" in plan


def test_template_paths_read_the_graph_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(x):
        seen.add(1)
        return x

    nodes = spark.createDataFrame([(f"{t}{k}", t) for t in ("a", "b", "c") for k in range(5)], "id string, type string")
    nodes = nodes.select(counted.asNondeterministic()("id").alias("id"), "type")
    edges = spark.createDataFrame([(f"a{k}", f"b{k}") for k in range(5)] + [(f"c{k}", f"b{k}") for k in range(3)], "source_id string, target_id string")
    got = templates.template_paths(nodes, edges, {"x": ["a", "b", "c"], "y": ["a", "b"], "z": ["c", "b", "a"]})
    assert sorted((r.template, ">".join(r.path)) for r in got.collect()) == sorted(
        [("x", f"a{k}>b{k}>c{k}") for k in range(3)] + [("y", f"a{k}>b{k}") for k in range(5)] + [("z", f"c{k}>b{k}>a{k}") for k in range(3)])
    assert seen.value == 15


def test_fused_groups_shuffle_once(spark):
    rows = [("c1", "metric", "e", None, "x", "o1", 0.1, "d1", 1), ("c2", "metric", "e", None, "x", "o1", 0.3, "d2", 2), ("c3", "metric", "e", None, "y", None, 0.1, "d1", 1), ("c4", "metric", "e", None, "y", "o1", 0.1, "d1", 1), ("c5", "relation", "e", None, "x", None, 0.1, "d1", 1)]
    schema = "candidate_id string, candidate_type string, entity_id string, predicate string, label string, object_name string, confidence double, document_id string, published_at int"
    got = promotion.fused_groups(spark.createDataFrame(rows, schema))
    assert sorted((r.candidate_type, r.group_label, r.members, r.conflict, r.status, ",".join(r.source_candidate_ids)) for r in got.collect()) == [
        ("metric", "x", 2, False, "fused", "c1,c2"), ("metric", "y", 1, True, "conflicted", "c3"), ("metric", "y", 1, True, "conflicted", "c4"), ("relation", "", 1, False, "invalid", "c5")]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan ==")[0].count("Exchange hashpartitioning") == 1
