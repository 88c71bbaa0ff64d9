"""Queries of the store's writes, reads, gates and governance rules over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from kgspark.operators import extract, graph, parse, promotion, reads, rules, store
from kgspark.plans.catalog import WITH, query
from kgspark.sources.fixtures import entities, outbox, placed, relations, table
from kgspark.streaming import outbox as stream

#: Facts: lines of orders as candidates, statements and assertions. The same expressions serve Spark and DuckDB.
FACT = (
    "'fact_' || l_orderkey || '_' || l_linenumber || '_' || l_partkey || '_' || l_suppkey as id", "'product_' || l_partkey as subject_id",
    "case l_linenumber % 3 when 0 then 'belongs_to' when 1 then 'active_in' else 'offers' end as predicate",
    "case when l_linenumber % 4 = 0 then 'unknown_' || l_suppkey else 'regional_market_' || (l_suppkey % 25) end as object_id",
    "case l_linenumber % 4 when 0 then 'metric' when 1 then 'relation' when 2 then 'statement' else 'event' end as knowledge_type",
    "l_returnflag as value", "'doc_' || (l_orderkey % 50) as document_id", "case when l_linestatus = 'O' then 'candidate' else 'active' end as status",
    "cast(l_linenumber as double) / 10 as confidence", "l_orderkey * 10 + l_linenumber as ord", "case when l_linenumber % 5 = 0 then 'brand' else 'product' end as mention_type",
)
FACTS = f"{WITH}, facts as (select {', '.join(FACT)} from lineitem), store_docs as (select 'doc_' || doc_id as document_id, 'Title ' || doc_id as title, doc_id as updated_at from documents)"
TYPES = ["product", "brand", "category", "organization", "audience", "regional_market", "industry"]
TYPE_LIST = ", ".join(f"'{t}'" for t in TYPES)
RULE_ROWS = [("active_in", "product", "regional_market"), ("active_in", "brand", "regional_market"), ("offers", "brand", "product"), ("belongs_to", "product", "category")]
RULE_SQL = "onto(relation_type, source_type, target_type) as (values " + ", ".join(str(r) for r in RULE_ROWS) + ")"


def facts(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").selectExpr(*FACT)


def store_docs(spark, d) -> DataFrame:
    return table(spark, d, "documents").selectExpr("'doc_' || doc_id as document_id", "'Title ' || doc_id as title", "doc_id as updated_at")


def ontology(spark) -> DataFrame:
    return spark.createDataFrame(RULE_ROWS, "relation_type string, source_type string, target_type string")


# --- parsing and extraction ---

HEADED = "n_nationkey as doc_id, '# A' || chr(10) || '### ' || n_name || chr(10) || 'line of text' || chr(10) || '## B' || chr(10) || '- item' as text"


@query("select n_nationkey as doc_id, o as order_index, replace(p, '@', n_name) as path from nation, (values (0, 'A'), (1, 'A/@'), (2, 'A/@'), (3, 'A/B'), (4, 'A/B')) t(o, p)", "")
def heading_path(spark, d):
    docs = table(spark, d, "nation").selectExpr(*HEADED.split(", ", 1))
    return parse.spans(docs).select("doc_id", F.col("order_index").cast("int").alias("order_index"), F.array_join("heading_path", "/").alias("path"))


@query("select c_custkey as doc_id, t.name as trigger from customer, (values (0, 'offers'), (1, 'targets'), (1, 'certification')) t(k, name) where c_custkey % 3 = t.k", "")
def relation_triggers(spark, d):
    text = F.when(F.col("c_custkey") % 3 == 0, "公司提供平台").when(F.col("c_custkey") % 3 == 1, "面向客户并取得等级").otherwise("nothing")
    units = table(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), F.lit("EU_00000").alias("unit_id"), text.alias("text"))
    return extract.candidates(units).where("kind = 'relation'").select("doc_id", F.col("value").alias("trigger"))


@query("select doc_no, unit_id from (select l_orderkey as doc_no, l_linenumber as unit_id, row_number() over (partition by l_orderkey order by l_linenumber) as k from lineitem) where k <= 3", "")
def units_first_of_document(spark, d):
    units = table(spark, d, "lineitem").selectExpr("l_orderkey as doc_id", "l_linenumber as unit_id")
    return promotion.capped_units(units, 3).select(F.col("doc_id").alias("doc_no"), "unit_id")


@query("""select id, knowledge_type as kind, case knowledge_type when 'relation' then 0.7 when 'statement' then 0.65 else confidence end as confidence, case when value = 'R' then 'llm:structured' else 'fallback:rules' end as generator from facts""", FACTS)
def model_candidates(spark, d):
    rows = facts(spark, d).select("id", F.col("knowledge_type").alias("kind"), F.lit("product").alias("type"), F.when(~F.col("knowledge_type").isin("relation", "statement"), F.col("confidence")).alias("confidence"), (F.col("value") == "R").alias("ok"), F.lit("rules").alias("method"))
    return promotion.emitted(rows, ["product"], promotion.MODEL_CONFIDENCE).select("id", "kind", "confidence", "generator")


@query("select document_id, subject_id from (select document_id, subject_id, row_number() over (partition by document_id order by case when mention_type = 'brand' then 0 else 1 end, ord, subject_id) as k from facts) where k = 1", FACTS)
def statement_subjects(spark, d):
    f = facts(spark, d)
    return reads.subjects(f.select("document_id").distinct(), f.select("document_id", F.col("subject_id").alias("entity_id"), F.col("mention_type").alias("type"), "ord"))


# --- writes ---

OLD_PROPS = "map('a', 'old', 'k', 'old') as scalars, cast(null as string) as source_document_id, array('d' || s_nationkey, 'd7') as source_document_ids, array('x', 'b' || (s_suppkey % 3)) as aliases, array('r1') as evidence_refs"


@query("""select id, case when scalar = 'new' then srcs[1] end as source, array_to_string(list_filter(srcs, lambda x, i: scalar = 'old' or list_position(srcs, x) = i), ',') as sources, array_to_string(list_filter(als, lambda x, i: scalar = 'old' or list_position(als, x) = i), ',') as aliases, scalar from (
 select 's' || s_suppkey as id, case when s_suppkey % 2 = 0 then ['d' || s_nationkey, 'd7', 'd' || (s_suppkey % 25)] else ['d' || s_nationkey, 'd7'] end as srcs, case when s_suppkey % 2 = 0 then ['x', 'b' || (s_suppkey % 3), 'b' || (s_suppkey % 2), 'c'] else ['x', 'b' || (s_suppkey % 3)] end as als, case when s_suppkey % 2 = 0 then 'new' else 'old' end as scalar from supplier)""", "")
def property_merge(spark, d):
    s = table(spark, d, "supplier").withColumn("id", F.expr("'s' || s_suppkey"))
    old = s.select("id", F.expr(f"struct({OLD_PROPS})").alias("properties"))
    fresh = "map('a', 'new') as scalars, 'd' || (s_suppkey % 25) as source_document_id, cast(null as array<string>) as source_document_ids, array('b' || (s_suppkey % 2), 'c') as aliases, array('r1') as evidence_refs"
    new = s.where("s_suppkey % 2 = 0").select("id", F.expr(f"struct({fresh})").alias("properties"))
    p = store.merge_entities(old, new).select("id", "properties.*")
    return p.select("id", F.col("source_document_id").alias("source"), F.array_join("source_document_ids", ",").alias("sources"), F.array_join("aliases", ",").alias("aliases"), F.col("scalars")["a"].alias("scalar"))


@query("""select 'documents' as part, document_id as id, title as content from (select 'doc_' || doc_id as document_id, case when doc_id % 3 = 0 then 'New ' else 'Old ' end || doc_id || '/' || doc_id as title from documents)
 union all select 'statements', id, 'old' from facts where cast(substr(document_id, 5) as int) % 3 <> 0 union all select 'statements', 'new_' || doc_id, 'new' from documents where doc_id % 3 = 0
 union all select 'outbox', 'e' || (doc_id % 7) || '/' || processed, 'upsert' from (select distinct doc_id % 7 as doc_id, 'false' as processed from documents where doc_id % 3 = 0)
 union all select 'outbox', 'e1/true', 'upsert'""", FACTS)
def bundle_replace(spark, d):
    raw = table(spark, d, "documents").select("doc_id", F.expr("'doc_' || doc_id").alias("document_id"))
    docs = raw.select("document_id", F.expr("'Old ' || doc_id").alias("title"), F.col("doc_id").alias("created_at"))
    came = raw.where("doc_id % 3 = 0")
    bundle = {
        "documents": came.select("document_id", F.expr("'New ' || doc_id").alias("title"), F.lit(-1).cast("bigint").alias("created_at")),
        "statements": came.select("document_id", F.expr("'new_' || doc_id").alias("id"), F.lit("new").alias("text")),
        "entities": came.select(F.expr("'e' || (doc_id % 7)").alias("id")).distinct().withColumn("properties", F.expr("struct(map('k', 'v') as scalars, 'd' as source_document_id, cast(null as array<string>) as source_document_ids, cast(null as array<string>) as aliases, cast(null as array<string>) as evidence_refs)")),
    }
    events = spark.createDataFrame([("entity", "e1", "upsert", True), ("entity", "e2", "upsert", False)], "aggregate_type string, aggregate_id string, event_type string, processed boolean")
    held = {"documents": docs, "statements": facts(spark, d).select("document_id", "id", F.lit("old").alias("text")), "entities": bundle["entities"].limit(0), "outbox": events}
    out = store.replace_bundle(held, bundle)
    parts = out["documents"].select(F.lit("documents").alias("part"), F.col("document_id").alias("id"), F.concat("title", F.lit("/"), F.col("created_at").cast("string")).alias("content"))
    parts = parts.unionByName(out["statements"].select(F.lit("statements").alias("part"), "id", F.col("text").alias("content")))
    return parts.unionByName(out["outbox"].select(F.lit("outbox").alias("part"), F.concat("aggregate_id", F.lit("/"), F.col("processed").cast("string")).alias("id"), F.col("event_type").alias("content")))


@query("select distinct aggregate_id from outbox where processed and event_type = 'upsert' and not exists (select 1 from outbox p where not p.processed and p.aggregate_id = outbox.aggregate_id and p.event_type = outbox.event_type)")
def pending_absent(spark, d):
    rows = outbox(spark, d)
    new = rows.where("processed and event_type = 'upsert'")
    return store.absent_events(rows, new).select("aggregate_id")


@query("""select source_id, 'unit' as source_type, 'm' as model, max(created_at) as created_at from (select vec_id % 50 as source_id, vec_id as created_at from embeddings) group by 1
 union all select 1000 + vec_id, 'unit', 'm', -1 from embeddings where vec_id < 10""", "")
def embeddings_upsert(spark, d):
    v = table(spark, d, "embeddings")
    tail = [F.lit("unit").alias("source_type"), F.lit("m").alias("model")]
    old = v.where("vec_id < 10").select((F.col("vec_id") + 1000).alias("source_id"), *tail, F.lit(-1).cast("bigint").alias("created_at"), "embedding")
    old = old.unionByName(v.where("vec_id < 20").select("vec_id", *tail, F.lit(-1).cast("bigint").alias("created_at"), "embedding").withColumnRenamed("vec_id", "source_id"))
    new = v.select((F.col("vec_id") % 50).alias("source_id"), *tail, F.col("vec_id").cast("bigint").alias("created_at"), "embedding")
    return store.upsert_embeddings(old, new).select("source_id", "source_type", "model", "created_at")


@query("select s_suppkey as id, case when s_suppkey % 2 = 0 then 'n' else 'o' end as name, greatest(case when s_suppkey % 2 = 0 then (s_suppkey % 10) / 10.0 else 0 end, 0.4)::double as confidence from supplier", "")
def gate_entity_confidence(spark, d):
    s = table(spark, d, "supplier")
    old = s.select(F.col("s_suppkey").alias("id"), F.lit("o").alias("name"), F.lit(0.4).alias("confidence"))
    new = s.where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("id"), F.lit("n").alias("name"), ((F.col("s_suppkey") % 10) / 10).alias("confidence"))
    return store.greatest_confidence(old, new, ["id"])


@query("select r_regionkey::int as position, 'v' || r_regionkey || case when r_regionkey = 3 then 'x' else '' end as version, case when r_regionkey < 4 then 'v' || r_regionkey end as expected from region where r_regionkey >= 3", "")
def migrations_out_of_place(spark, d):
    applied = table(spark, d, "region").selectExpr("cast(r_regionkey as int) as position", "'v' || r_regionkey || if(r_regionkey = 3, 'x', '') as version")
    return store.misplaced_migrations(applied, ["v0", "v1", "v2", "v3"])


# --- reads ---


@query("select document_id, coalesce((select count(*) from facts f where f.document_id = x.document_id and knowledge_type = 'relation'), 0) as relations, coalesce((select count(*) from facts f where f.document_id = x.document_id and knowledge_type = 'statement'), 0) as statements, coalesce((select count(*) from facts f where f.document_id = x.document_id and status = 'candidate'), 0) as candidates from store_docs x", FACTS)
def document_row_counts(spark, d):
    f = facts(spark, d)
    return reads.document_counts(store_docs(spark, d), relations=f.where("knowledge_type = 'relation'"), statements=f.where("knowledge_type = 'statement'"), candidates=f.where("status = 'candidate'"))


@query("select 'documents' as \"table\", count(*) as n from documents union all select 'entities', count(*) from entities union all select 'relations', count(*) from relations union all select 'statements', count(*) from facts union all select 'outbox', count(*) from outbox", FACTS)
def store_counts(spark, d):
    return reads.table_counts(documents=store_docs(spark, d), entities=entities(spark, d), relations=relations(spark, d), statements=facts(spark, d), outbox=outbox(spark, d))


@query("select document_id from store_docs where title = 'Title 7'", FACTS)
def document_by_title(spark, d):
    return reads.resolved(store_docs(spark, d), "Title 7")


@query("select document_id, title from store_docs order by updated_at desc, document_id limit 100", FACTS)
def documents_newest(spark, d):
    return reads.Api({"documents": store_docs(spark, d)}).documents().select("document_id", "title")


@query("select f.id, e.name as subject_name, e.type as subject_type from facts f left join entities e on f.subject_id = e.id", FACTS)
def statements_with_subject(spark, d):
    return reads.with_subject(facts(spark, d), entities(spark, d)).select("id", "subject_name", "subject_type")


SCOPED = "exists (select 1 from facts f where f.document_id = 'doc_7' and (f.subject_id = e.id or (f.knowledge_type = 'relation' and f.object_id = e.id)))"


@query(f"select id from entities e where {SCOPED} or e.id = 'industry_1'", FACTS)
def document_scope(spark, d):
    f = facts(spark, d)
    e = entities(spark, d).withColumn("source_document_ids", F.when(F.col("id") == "industry_1", F.array(F.lit("doc_7"))))
    rel = f.where("knowledge_type = 'relation'").select("document_id", F.col("subject_id").alias("source_id"), F.col("object_id").alias("target_id"))
    return reads.in_document(e, rel, f.where("knowledge_type <> 'relation'"), "doc_7").select("id")


@query(f"select * from (select 'entity' as kind, id from entities e where status = 'active' and type in ('product', 'solution', 'service') and {SCOPED} order by updated_at desc, id limit 8) union all select * from (select 'statement', id from facts where document_id = 'doc_7' and knowledge_type <> 'relation' order by ord desc, id limit 8)", FACTS)
def search_document_scope(spark, d):
    f = facts(spark, d)
    e = entities(spark, d).withColumn("source_document_ids", F.array().cast("array<string>"))
    rel = f.where("knowledge_type = 'relation'").select("document_id", F.col("subject_id").alias("source_id"), F.col("object_id").alias("target_id"))
    said = f.where("knowledge_type <> 'relation'").withColumns({"statement_id": F.col("id"), "created_at": F.col("ord")})
    return reads.answered("文档 doc_7 里的产品", e, rel, said, store_docs(spark, d))


#: Turns of conversations as questions, most with a marker put before or after them.
ASKED = "case (conv_id + turn) % 9 when 0 then concat('Acme', conv_id, '品牌的产品') when 1 then '品牌有哪些' when 2 then concat('文档 doc_', conv_id, ' 有什么') when 3 then '总结当前知识库' when 4 then concat('本文讲什么', turn) when 5 then concat('市场 ', text) when 6 then concat('品牌是B', turn, ' 的功能和客户') when 7 then concat('x', conv_id, ' 品牌 文档: d.', turn) else text end"


@query(f"""select conv_id, turn, kind, types, case when kind = 'scoped' and b then case when before <> '' then before when after in ('的', '是', '有哪些', '什么') then '' else after end end as brand, case when kind = 'scoped' and dd then doc end as document from (
 select *, case when dd and doc = '' then 'none' when b or dd then 'scoped' when contains(q, '总结当前知识库') then 'overview' else 'plain' end as kind, array_to_string(list_sort(list_distinct(list_concat(list_concat(case when contains(q, '产品') then ['product', 'solution', 'service'] else [] end, case when contains(q, '功能') or contains(q, '能力') then ['capability', 'service'] else [] end),
  list_concat(case when contains(q, '客户') or contains(q, '用户') then ['customer', 'audience'] else [] end, case when contains(q, '市场') or contains(q, '行业') then ['industry', 'organization', 'audience'] else [] end)))), ',') as types
 from (select *, contains(q, '品牌') as b, contains(q, '文档') or contains(q, '资料') or contains(q, '本文') as dd, regexp_extract(q, '([A-Za-z0-9_\\-一-鿿]{{1,64}})\\s*品牌', 1) as before, regexp_extract(q, '品牌\\s*(?:是|为|[:：])?\\s*([A-Za-z0-9_\\-一-鿿]{{1,64}})', 1) as after, regexp_extract(q, '文档\\s*(?:[:：]\\s*)?([A-Za-z0-9_.\\-]{{1,128}})', 1) as doc
  from (select conv_id, turn, trim(coalesce({ASKED}, '')) as q from conversations) x) y) z""", "")
def intent_route(spark, d):
    asked = table(spark, d, "conversations").selectExpr("conv_id", "turn", f"{ASKED} as question")
    return reads.routed(asked).select("conv_id", "turn", "kind", F.array_join("types", ",").alias("types"), "brand", "document")


@query(""", n as (select * from entities where status = 'active' and layer = 'l2_industry' and type <> 'audience' order by updated_at desc, id limit 5000), r as (select *, source_id || '>' || target_id || '>' || relation_type as id from relations where source_id in (select id from n) and target_id in (select id from n) order by created_at desc, source_id, target_id, relation_type limit 10000),
 refs as (select 'node' as kind, id, 'd' || (updated_at % 50) as doc, updated_at % 7 + 1 as unit from n union all select 'node', id, 'd7', updated_at % 5 + 1 from n union all select 'edge', id, 'd' || (created_at % 50), created_at % 7 + 1 from r),
 u as (select distinct 'd' || (l_orderkey % 50) as doc, l_linenumber as unit from lineitem where l_orderkey % 3 <> 0),
 s as (select distinct doc, unit * 10 as a, unit * 10 + 5 as b from u union select distinct doc, unit * 10 + 10, unit * 10 + 15 from u),
 c as (select distinct refs.kind, refs.id, refs.doc, refs.unit, (select min(a) from s where s.doc = u.doc and a in (u.unit * 10, u.unit * 10 + 10)) as lo, (select max(b) from s where s.doc = u.doc and b in (u.unit * 10 + 5, u.unit * 10 + 15)) as hi from refs join u on u.doc = refs.doc and u.unit = refs.unit)
 select i.kind, i.id, coalesce((select string_agg(doc || '/' || unit || '/T ' || doc || '/' || lo || '-' || hi, ';' order by doc, unit) from c where c.kind = i.kind and c.id = i.id), '') as citations from (select 'node' as kind, id from n union all select 'edge', id from r) i""")
def graph_cited(spark, d):
    ref = lambda doc, unit: f"struct({doc} as document_id, {unit} as unit_id)"
    e = entities(spark, d).withColumn("evidence_refs", F.expr(f"array({ref(chr(39) + 'd' + chr(39) + ' || (updated_at % 50)', 'updated_at % 7 + 1')}, {ref(chr(39) + 'd7' + chr(39), 'updated_at % 5 + 1')})"))
    r = relations(spark, d).withColumns({"id": F.concat_ws(">", "source_id", "target_id", "relation_type"), "document_id": F.expr("'d' || (created_at % 50)"), "confidence": F.lit(0.6), "evidence_refs": F.expr(f"array({ref('cast(null as string)', 'created_at % 7 + 1')})")})
    units = table(spark, d, "lineitem").where("l_orderkey % 3 <> 0").selectExpr("'d' || (l_orderkey % 50) as document_id", "cast(l_linenumber as bigint) as unit_id").distinct().withColumn("source_span_ids", F.array("unit_id", F.col("unit_id") + 1))
    spans = units.select("document_id", F.explode("source_span_ids").alias("span_id")).distinct().selectExpr("document_id", "span_id", "span_id * 10 as char_start", "span_id * 10 + 5 as char_end")
    docs = units.select("document_id").distinct().withColumn("title", F.concat(F.lit("T "), "document_id"))
    nodes, edges = graph.cited(e.where("type <> 'audience'"), r, units, spans, docs, 5000, "l2_industry")
    text = F.array_join(F.transform("citations", lambda c: F.concat_ws("/", c["document_id"], c["unit_id"], c["title"], F.concat_ws("-", c["char_start"], c["char_end"]))), ";")
    return nodes.select(F.lit("node").alias("kind"), "id", text.alias("citations")).unionByName(edges.select(F.lit("edge").alias("kind"), "id", text.alias("citations")))


@query("""select item, document_id, 'Title ' || document_id as title, unit_id, char_start, char_end from (select l_orderkey as item, (l_orderkey % 100)::varchar as document_id, l_linenumber as unit_id, l_linenumber * 10 as char_start, l_linenumber * 10 + 15 as char_end, row_number() over (partition by l_orderkey order by l_linenumber) as k from (select distinct l_orderkey, l_linenumber from lineitem)) where k <= 3""", "")
def citations_titled(spark, d):
    li = table(spark, d, "lineitem")
    refs = li.selectExpr("l_orderkey as item", "l_orderkey % 100 as doc_id", "l_linenumber as unit_id")
    units = refs.select("doc_id", "unit_id").distinct().withColumn("source_span_ids", F.array("unit_id", F.col("unit_id") + 1))
    spans = units.select("doc_id", F.explode("source_span_ids").alias("span_id")).distinct().selectExpr("doc_id", "span_id", "span_id * 10 as char_start", "span_id * 10 + 5 as char_end")
    titles = units.select(F.col("doc_id").cast("string").alias("document_id")).distinct().withColumn("title", F.concat(F.lit("Title "), F.col("document_id")))
    return reads.citations(refs, units, spans, titles, first=3)


@query("select string_agg(k || '. [nation] ' || n_name, chr(10) order by k) as context from (select n_name, row_number() over (order by n_nationkey) as k from nation) where k <= 12", "")
def answer_context(spark, d):
    hits = table(spark, d, "nation").select(F.col("n_nationkey").alias("position"), F.lit("nation").alias("kind"), F.col("n_name").alias("text"))
    return reads.context(hits)


@query("select conv_id, turn from conversations where conv_id in (select conv_id from conversations where role in ('user', 'assistant') group by conv_id having count(distinct role) = 2)", "")
def complete_exchanges(spark, d):
    rows = table(spark, d, "conversations").withColumnRenamed("conv_id", "exchange_id")
    return reads.complete_exchanges(rows).select(F.col("exchange_id").alias("conv_id"), "turn")


@query("select entity_type, normalized_name, min(name) as name, sum(n)::bigint as n from (select 'product' as entity_type, lower(subject_id) as normalized_name, subject_id as name, count(*) as n from facts group by 2, 3 union all select 'market', lower(object_id), object_id, count(*) from facts group by 2, 3) group by 1, 2", FACTS)
def entity_rollup(spark, d):
    rows = facts(spark, d).select(F.lit("product").alias("subject_type"), F.col("subject_id").alias("subject_name"), F.lit("market").alias("object_type"), F.col("object_id").alias("object_name"), F.array("id").alias("refs"), "ord")
    return reads.entity_rollup(rows).select("entity_type", "normalized_name", "name", "n")


@query("select subject_id, predicate, id from (select *, row_number() over (partition by subject_id, predicate order by ord) as k from facts) where k = 1", FACTS)
def relations_first(spark, d):
    rows = placed(spark, d, "lineitem").selectExpr(*FACT, "kg_place")
    return reads.first_of(rows, ["subject_id", "predicate"], ["ord", "kg_place"]).select("subject_id", "predicate", "id")


@query("select knowledge_type, status, count(*) as n from facts group by 1, 2", FACTS)
def candidates_by_type(spark, d):
    return facts(spark, d).groupBy("knowledge_type", "status").agg(F.count("*").alias("n"))


# --- gates and fusion ---


@query(f""", {RULE_SQL} select f.id, (s.type is null or s.type in ({TYPE_LIST})) and (o.type is null or o.type in ({TYPE_LIST})) and (f.knowledge_type <> 'relation' or exists (select 1 from onto r where r.relation_type = f.predicate and r.source_type = s.type and r.target_type = o.type)) as gate_ontology
 from facts f left join entities s on s.id = f.subject_id left join entities o on o.id = f.object_id""", FACTS)
def gate_ontology(spark, d):
    return promotion.ontology_gate(facts(spark, d), entities(spark, d), TYPES, ontology(spark)).select("id", "gate_ontology")


@query("select l_orderkey, l_linenumber, l_linenumber % 3 <> 0 and l_returnflag <> 'A' and l_linestatus = 'O' as gate_evidence from lineitem", "")
def gate_evidence(spark, d):
    refs = F.expr("if(l_linenumber % 3 = 0, cast(array() as array<struct<access_status:string,support_status:string>>), array(struct('ok' as access_status, 'supports' as support_status), struct(if(l_returnflag = 'A', 'blocked', 'crawled') as access_status, if(l_linestatus = 'O', 'verified', null) as support_status)))")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", promotion.evidence_gate(refs).alias("gate_evidence"))


@query("select c.id, not (c.knowledge_type = 'relation' and exists (select 1 from facts a where a.status = 'active' and a.subject_id = c.subject_id and a.predicate = c.predicate and a.object_id <> c.object_id)) as gate_conflict from facts c where c.status = 'candidate'", FACTS)
def gate_conflict(spark, d):
    f = facts(spark, d)
    return promotion.conflict_gate(f.where("status = 'candidate'"), f.where("status = 'active'")).select("id", "gate_conflict")


FUSED = """cands as (select f.id, knowledge_type, e.id as entity_id, case when knowledge_type = 'relation' then predicate else value end as label, object_id, f.confidence from facts f join entities e on e.id = f.subject_id where e.status = 'active'),
 groups as (select knowledge_type, entity_id, label, count(*) as n, count(distinct object_id) as objects from cands group by 1, 2, 3)"""


@query(f""", {FUSED} select knowledge_type as candidate_type, entity_id, label as group_label, min(object_id) as object_name, max(confidence) as confidence, count(*) as members, true as conflict, id as sources from cands join groups using (knowledge_type, entity_id, label) where n > 1 and objects > 1 group by id, 1, 2, 3
 union all select knowledge_type, entity_id, label, arg_min(object_id, id), max(confidence), count(*), false, string_agg(distinct id, ',' order by id) from cands join groups using (knowledge_type, entity_id, label) where not (n > 1 and objects > 1) group by 1, 2, 3""", FACTS)
def fusion_groups(spark, d):
    g = _fused(spark, d)
    return g.select("candidate_type", "entity_id", "group_label", "object_name", "confidence", "members", "conflict", F.array_join("source_candidate_ids", ",").alias("sources"))


def _fused(spark, d) -> DataFrame:
    gate = entities(spark, d).where("status = 'active'").select(F.col("type").alias("entity_type"), F.col("id").alias("normalized_name"), F.col("id").alias("entity_id"))
    spelled = F.upper(F.regexp_replace("subject_id", "_", " _、"))
    cands = facts(spark, d).select(F.col("id").alias("candidate_id"), F.col("knowledge_type").alias("candidate_type"), F.lit("product").alias("subject_type"), spelled.alias("subject_name"), "predicate", F.col("value").alias("label"), F.col("object_id").alias("object_name"), "confidence", "document_id", F.col("ord").alias("published_at"))
    return promotion.fused_groups(promotion.anchored(cands, gate))


@query(f""", {FUSED} select coalesce(sum(n - 1) filter (not (n > 1 and objects > 1)), 0)::bigint as fused, coalesce(sum(n) filter (n > 1 and objects > 1), 0)::bigint as conflicted, (count(*) filter (not (n > 1 and objects > 1)) + coalesce(sum(n) filter (n > 1 and objects > 1), 0))::bigint as emitted, count(*) filter (n > 1 and objects > 1) as conflict_groups from groups""", FACTS)
def fusion_counts(spark, d):
    return promotion.fusion_counts(_fused(spark, d))


@query("select knowledge_type as kind, id from facts where confidence >= 0.3 and (knowledge_type <> 'metric' or value is not null)", FACTS)
def promotion_writers(spark, d):
    rows = facts(spark, d).withColumn("disposition", F.when(F.col("confidence") >= 0.3, "promote").otherwise("reject"))
    parts = [df.select(F.lit(kind).alias("kind"), "id") for kind, df in promotion.promoted(rows).items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(f""", {RULE_SQL}, ents as (select distinct l_orderkey as payload_id, 'p' || l_linenumber as id, case when l_linenumber = 7 then 'ghost' when l_linenumber % 2 = 0 then 'product' else 'regional_market' end as type from lineitem),
 rels as (select l_orderkey as payload_id, 'p' || l_linenumber as subject, case when l_linenumber % 5 = 0 then 'likes' else 'active_in' end as relation, 'p' || (l_linenumber + 1) as object, l_linenumber / 6.0 as confidence from lineitem)
 select payload_id, 'entity' as kind, id, 'unknown entity type' as error from ents where type = 'ghost'
 union all select payload_id, 'relation', subject || '-' || relation || '-' || object, 'unknown relation type' from rels where relation = 'likes'
 union all select r.payload_id, 'relation', subject || '-' || relation || '-' || object, 'object not found' from rels r where relation <> 'likes' and not exists (select 1 from ents e where e.payload_id = r.payload_id and e.id = r.object)
 union all select r.payload_id, 'relation', subject || '-' || relation || '-' || object, 'domain/range invalid' from rels r join ents s on s.payload_id = r.payload_id and s.id = r.subject join ents o on o.payload_id = r.payload_id and o.id = r.object where relation <> 'likes' and not exists (select 1 from onto where relation_type = relation and source_type = s.type and target_type = o.type)
 union all select payload_id, 'relation', subject || '-' || relation || '-' || object, 'confidence out of [0,1]' from rels where relation <> 'likes' and confidence > 1
 union all select l_orderkey, 'statement', 's' || l_linenumber, 'invalid statement_class' from lineitem where l_returnflag = 'R'""", "with none as (select 1 as x)")
def payload_errors(spark, d):
    li = table(spark, d, "lineitem")
    ents = li.select("l_orderkey", "l_linenumber").distinct().selectExpr("l_orderkey as payload_id", "'p' || l_linenumber as id", "case when l_linenumber = 7 then 'ghost' when l_linenumber % 2 = 0 then 'product' else 'regional_market' end as type")
    rels = li.selectExpr("l_orderkey as payload_id", "'p' || l_linenumber as subject", "if(l_linenumber % 5 = 0, 'likes', 'active_in') as relation", "'p' || (l_linenumber + 1) as object", "l_linenumber / 6.0 as confidence")
    stmts = li.selectExpr("l_orderkey as payload_id", "'s' || l_linenumber as id", "if(l_returnflag = 'R', 'rumour', 'fact') as statement_class")
    return promotion.payload_errors(ents, rels, stmts, TYPES, ontology(spark), ["fact", "claim", "observation", "inference"])


@query("select l_orderkey, l_linenumber, case when l_linenumber = 1 then 'fail_with_rejection' when l_linenumber = 2 then 'fail_with_retry' when l_linenumber = 3 then 'escalate_to_review' else 'pass' end as outcome from lineitem", "")
def policy_outcomes(spark, d):
    passed = {name: F.lit(True) for name, _ in promotion.POLICY_GATES}
    passed |= {"entity_types": F.col("l_linenumber") != 1, "traceable_source": ~F.col("l_linenumber").isin(1, 2), "no_conflict": F.col("l_linenumber") > 3}
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", promotion.policy_outcome(passed).alias("outcome"))


# --- governance ---


@query("select l_orderkey, l_linenumber from lineitem where l_linenumber % 2 = 0 and l_returnflag <> 'A' and l_linestatus <> 'F'", "")
def governance_filter(spark, d):
    rows = table(spark, d, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "if(l_linenumber % 2 = 0, array('report', 'chat'), array('chat')) as allowed_task_types", "array('customer_report') as allowed_output_channels",
        "if(l_returnflag = 'A', 'prohibited', 'approved') as publication_status", "if(l_linestatus = 'F', 'confidential', 'public') as access_level",
    )
    return rows.where(rules.may_use("report", "customer_report", "internal")).select("l_orderkey", "l_linenumber")


@query("select p_partkey from part where p_size > 25 or p_brand = 'Brand#12'", "")
def scope_filter(spark, d):
    rows = table(spark, d, "part").withColumns({"scope": F.expr("if(p_size > 25, 'shared', 'brand_specific')"), "brand_id": F.col("p_brand")})
    return rows.where(rules.in_scope("Brand#12")).select("p_partkey")


@query("select event_id from events where event_type <> 'error'", "")
def evidence_types(spark, d):
    return table(spark, d, "events").where(rules.evidence_allowed(F.when(F.col("event_type") == "error", "blocked_pages").otherwise(F.col("event_type")))).select("event_id")


@query("select c_custkey from customer where c_mktsegment = 'BUILDING'", "")
def tenant_rows(spark, d):
    return rules.for_tenant(table(spark, d, "customer"), "BUILDING", "c_mktsegment").select("c_custkey")


@query("select page_id, h as host, h = 'example.org' or h like '%.example.org' as is_blocked, h = 'example.com' or h like '%.example.com' as is_trusted from (select page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]*)', 1)) as h from pages)", "")
def source_domains(spark, d):
    one = lambda x: spark.createDataFrame([(x,)], "domain string")
    return rules.with_source_rules(table(spark, d, "pages").select("page_id", "url"), "url", one("example.org"), one("example.com")).select("page_id", "host", "is_blocked", "is_trusted")


@query("select p_partkey, case p_size % 4 when 0 then 'high' when 1 then 'medium' when 2 then 'low' end as authority, case p_size % 3 when 0 then 'fact' when 1 then 'claim' else 'inference' end as statement_class, case p_size % 3 when 0 then 'false_by_default' when 1 then 'false' else 'not_as_stable_fact' end as public_output from part", "")
def source_authority(spark, d):
    size = F.col("p_size")
    kind = F.when(size % 4 == 0, "academic").when(size % 4 == 1, "media").when(size % 4 == 2, "community").otherwise("unknown")
    said = F.when(size % 3 == 0, "internal_fact").when(size % 3 == 1, "draft_claim").otherwise("inference")
    return table(spark, d, "part").select("p_partkey", rules.authority(kind).alias("authority"), rules.statement_class(said).alias("statement_class"), rules.public_output(said).alias("public_output"))


@query("""select l_orderkey, l_linenumber, concat_ws(',', case when l_linenumber % 5 = 4 then 'statement_class missing' end, case when l_linenumber % 5 in (0, 1) and l_returnflag = 'R' then 'source_refs missing' end, case when l_linenumber % 5 = 2 and l_linestatus = 'F' then 'validity missing' end, case when l_linenumber % 5 = 3 then 'supporting_assertion_refs missing' end) as errors from lineitem""", "")
def assertion_rules(spark, d):
    rows = table(spark, d, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "case l_linenumber % 5 when 0 then 'fact' when 1 then 'claim' when 2 then 'observation' when 3 then 'inference' end as statement_class",
        "if(l_returnflag = 'R', cast(array() as array<string>), array('s')) as source_refs", "if(l_linestatus = 'F', null, l_shipdate) as valid_from", "cast(null as date) as valid_to", "cast(null as array<string>) as supporting_refs",
    )
    return rows.select("l_orderkey", "l_linenumber", F.array_join(rules.assertion_errors(), ",").alias("errors"))


@query("select n_nationkey, case when n_nationkey % 2 = 0 then 'assertions,conflicts,entities,evidence,missing_information,relations' else 'assertions,conflicts,entities,evidence,missing_information,query,relations,scope' end as missing, case when n_nationkey % 2 = 0 then 'regional_market' else 'category,regional_market,valid_time' end as context_missing from nation", "")
def required_fields(spark, d):
    have = F.expr("if(n_nationkey % 2 = 0, array('query', 'scope'), null)")
    ctx = F.expr("if(n_nationkey % 2 = 0, array('category', 'valid_time'), null)")
    return table(spark, d, "nation").select("n_nationkey", F.array_join(rules.missing_fields(have), ",").alias("missing"), F.array_join(rules.missing_fields(ctx, ("valid_time", "category", "regional_market")), ",").alias("context_missing"))


@query("select s_suppkey, concat_ws(',', case when s_suppkey % 2 = 0 then 'proposal_id is required' end, case when s_suppkey % 3 = 0 then 'proposal_type' end, case when s_suppkey % 5 = 0 then 'status' end, case when s_suppkey % 7 = 0 then 'evidence is required' end, case when s_suppkey % 5 = 1 then 'published proposals require rollback_plan' end) as errors from supplier", "")
def change_proposals(spark, d):
    rows = table(spark, d, "supplier").selectExpr(
        "s_suppkey", "if(s_suppkey % 2 = 0, '', s_name) as proposal_id", "if(s_suppkey % 3 = 0, 'odd', 'add') as proposal_type", "case s_suppkey % 5 when 0 then 'lost' when 1 then 'published' end as status",
        "if(s_suppkey % 7 = 0, cast(array() as array<string>), array('e')) as evidence", "cast(null as string) as rollback_plan",
    )
    return rows.select("s_suppkey", F.array_join(rules.proposal_errors(["add", "change"], ["draft", "published"]), ",").alias("errors"))


FLAGS = {"resolved": "l_linenumber > 1", "relation_valid": "l_returnflag = 'R'", "has_evidence": "l_linestatus = 'O'", "conflict_found": "l_linenumber = 2", "is_duplicate": "l_linenumber = 3", "stale_found": "l_returnflag = 'A'", "promoted": "l_linenumber > 4", "grounded": "l_returnflag <> 'N'"}
METRICS = ("entity_resolution_accuracy", "relation_validity_rate", "evidence_coverage", "conflict_detection_rate", "duplicate_rate", "stale_detection_rate", "promotion_acceptance_rate", "retrieval_grounding_rate")


@query("select l_suppkey % 10 as grp, " + ", ".join(f"round(avg(case when {c} then 1.0 else 0.0 end), 4) as {m}" for m, c in zip(METRICS, FLAGS.values())) + " from lineitem group by 1", "")
def governance_metrics(spark, d):
    rows = table(spark, d, "lineitem").selectExpr("l_suppkey % 10 as grp", *[f"{c} as {n}" for n, c in FLAGS.items()])
    return rules.governance_metrics(rows, ["grp"])


@query("select l_suppkey, count(distinct p) as held, (select count(distinct p_type) from part where p_size > 25) as wanted, round(count(distinct p)::double / (select count(distinct p_type) from part where p_size > 25), 4) as coverage from (select l_suppkey, case when p_type in (select p_type from part where p_size > 25) then p_type end as p from lineitem join part on l_partkey = p_partkey) group by 1", "")
def capability_coverage_by_group(spark, d):
    part = table(spark, d, "part")
    have = table(spark, d, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).select("l_suppkey", "p_type")
    return rules.coverage(have, part.where("p_size > 25"), "l_suppkey", "p_type")


@query("select l_partkey, l_returnflag, count(*) as n, date_diff('day', min(l_shipdate)::date, max(l_shipdate)::date) as days, count(*) filter (l_linenumber = 1) as high, count(*) >= 3 and date_diff('day', min(l_shipdate)::date, max(l_shipdate)::date) >= 7 and count(*) filter (l_linenumber = 1) >= 1 as is_fact from lineitem group by 1, 2", "")
def fact_ready(spark, d):
    return rules.fact_ready(table(spark, d, "lineitem").withColumn("high", F.col("l_linenumber") == 1), ["l_partkey"], "l_returnflag", "l_shipdate", "high").withColumn("days", F.col("days").cast("bigint")).select("l_partkey", "l_returnflag", "n", "days", F.col("high"), "is_fact")


@query("select o_orderkey::varchar as o_orderkey, 'o_orderstatus' as \"column\", o_orderstatus as value from orders where o_orderstatus not in ('O', 'F') union all select o_orderkey::varchar, 'o_orderpriority', o_orderpriority from orders where o_orderpriority <> '1-URGENT'", "")
def enum_checks(spark, d):
    return rules.out_of_enum(table(spark, d, "orders"), "o_orderkey", {"o_orderstatus": ["O", "F"], "o_orderpriority": ["1-URGENT"]})


@query("select id from entities where type = 'product' and id not in (select source_id from relations where relation_type = 'active_in' and target_id = 'regional_market_7')")
def required_links(spark, d):
    return rules.without_link(entities(spark, d), relations(spark, d).where("target_id = 'regional_market_7'"), "product", "active_in").select("id")


@query("select target_id as \"end\", count(*) as n from relations where relation_type = 'active_in' group by 1 having count(*) > 1")
def cardinality_ends(spark, d):
    return rules.too_many(relations(spark, d), "active_in", "target_id")


@query("select g.g as \"group\", coalesce((select string_agg(distinct n_name, ',' order by n_name) from nation where n_regionkey::varchar = g.g), '') as codes from (select r_regionkey::varchar as g from region union all select 'none') g", "")
def layer_dimensions(spark, d):
    codes = table(spark, d, "nation").selectExpr("cast(n_regionkey as string) as group", "n_name as code")
    return rules.dimensions(codes, ["0", "1", "2", "3", "4", "none"]).select("group", F.array_join("codes", ",").alias("codes"))


# --- graph ---


@query("select id, name, case when type = 'regional_market' then 'RegionalMarket' else upper(type[1]) || type[2:] end as label, case layer when 'l3_brand' then 'L3' else 'L2' end as layer_tag from entities where status = 'active'")
def projected_vertices(spark, d):
    return stream.projected(entities(spark, d), relations(spark, d))[0]


@query("select source_id, target_id, relation_type from relations where source_id in (select id from entities where status = 'active') and target_id in (select id from entities where status = 'active')")
def projected_edges(spark, d):
    return stream.projected(entities(spark, d), relations(spark, d))[1].select("source_id", "target_id", "relation_type")


@query("select id as source_id, subject_id as target_id, 'SUBJECT' as relation_type from facts union all select id, object_id, 'OBJECT' from facts", FACTS)
def assertion_links(spark, d):
    return stream.reified(facts(spark, d))[1]


@query(""", gone as (select id from entities where type = 'regional_market' and status = 'deprecated') select source_id, target_id, relation_type from relations where source_id not in (select id from gone) and target_id not in (select id from gone)""")
def detached_edges(spark, d):
    gone = entities(spark, d).where("type = 'regional_market' and status = 'deprecated'").select("id", F.col("id").alias("aggregate_id"), F.lit("delete").alias("event_type"), F.lit(1).alias("created_at"))
    return stream.without_vertices(relations(spark, d), gone).select("source_id", "target_id", "relation_type")


@query("select source_id, target_id, relation_type from relations union select target_id, source_id, relation_type from relations where relation_type = 'active_in'")
def inverse_edges(spark, d):
    return graph.bidirectional(relations(spark, d).select("source_id", "target_id", "relation_type"), ["active_in"])


@query("with recursive up as (select s_suppkey as id, s_suppkey // 4 as ancestor, 1 as depth from supplier where s_suppkey >= 4 union all select id, ancestor // 4, depth + 1 from up where ancestor >= 4) select id, ancestor, depth from up", "")
def hierarchy_ancestors(spark, d):
    parents = table(spark, d, "supplier").selectExpr("s_suppkey as id", "if(s_suppkey >= 4, s_suppkey div 4, null) as parent")
    return graph.ancestors(parents)
