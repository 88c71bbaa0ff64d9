"""The registered queries and the SQL that gives the same rows in DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from kgspark.functions import exprs
from kgspark.operators import extract, gates, governance, graph, parse, retrieve, upsert
from kgspark.session import materialise
from kgspark.sources.fixtures import ENTITIES, OUTBOX, RELATIONS, entities, outbox, placed, relations, table
from kgspark.streaming import outbox as stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

WITH = f"with entities as ({ENTITIES}), relations as ({RELATIONS}), outbox as ({OUTBOX})"
#: Non-blank lines of documents with their places, for SQL.
LINES = """
lines as (
  select doc_id, i - 1 as line_no, l[i] as raw, s[i] as char_start from (
    select doc_id, l, list_transform(generate_series(1, len(l)), lambda k: coalesce(list_sum(list_transform(l[1:k-1], lambda x: length(x) + 1)), 0)) as s
    from (select doc_id, string_split(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(10)) as l from documents)
  ), unnest(generate_series(1, len(l))) as t(i) where trim(l[i]) <> '')
"""


def query(sql: str | None = None, prefix: str = WITH) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = f"{prefix} {sql}" if prefix else sql
        return f

    return add


# --- graph ---

NODES = "nodes as (select * from entities where status = 'active' and layer = 'l2_industry' order by updated_at desc, id limit 500)"


@query(f""", {NODES}, edges as (select r.* from relations r where source_id in (select id from nodes) and target_id in (select id from nodes)
 order by created_at desc, source_id, target_id, relation_type limit 1000)
select 'node' as kind, id, type as a, name as b, layer as label from nodes union all select 'edge', source_id || '>' || target_id, source_id, target_id, relation_type from edges""")
def graph_view(spark, d):
    return graph.view(entities(spark, d), relations(spark, d), 500, "l2_industry")


@query(", nodes as (select * from entities where status = 'active' and type in ('brand', 'product')) select r.* from relations r where source_id in (select id from nodes) and target_id in (select id from nodes)")
def induced_edges(spark, d):
    return graph.induced(relations(spark, d), entities(spark, d).where("status = 'active' and type in ('brand', 'product')"))


@query("select id, type, name, layer, updated_at from entities where status = 'active' and layer = 'l3_brand'")
def graph_layer_export(spark, d):
    return entities(spark, d).where("status = 'active' and layer = 'l3_brand'").select("id", "type", "name", "layer", "updated_at")


@query("select id, type, name from entities where status = 'active' and (brand_id = 'brand_Brand#11' or brand_id is null) order by updated_at desc, id limit 300")
def graph_brand_scope(spark, d):
    return graph.top_nodes(entities(spark, d), 300, brand="brand_Brand#11").select("id", "type", "name")


@query("select source_id, target_id, relation_type, s.layer as source_layer, t.layer as target_layer from relations r join entities s on s.id = source_id join entities t on t.id = target_id where s.layer <> t.layer")
def cross_layer_edges(spark, d):
    return graph.with_ends(relations(spark, d), entities(spark, d), ["layer"]).where("source_layer <> target_layer").drop("created_at")


@query("select id, type from entities where id not in (select source_id from relations union all select target_id from relations)")
def orphan_entities(spark, d):
    return graph.orphans(entities(spark, d), relations(spark, d)).select("id", "type")


@query(", seeds as (select id from entities where type = 'category') select id from seeds union select target_id from relations where source_id in (select id from seeds) union select source_id from relations where target_id in (select id from seeds)")
def neighbors_1hop(spark, d):
    return graph.neighbours(entities(spark, d).where("type = 'category'"), relations(spark, d))


@query("select b.source_id as n0, b.target_id as n1, c.target_id as n2 from relations b join relations c on c.source_id = b.target_id where b.relation_type = 'offers' and c.relation_type = 'belongs_to'")
def narrative_chain_paths(spark, d):
    return graph.paths(entities(spark, d), relations(spark, d).where("relation_type in ('offers', 'belongs_to')"), ["brand", "product", "category"])


@query("select type, count(*) as n from entities group by type")
def type_distribution(spark, d):
    return entities(spark, d).groupBy("type").agg(F.count("*").alias("n"))


ONTOLOGY = [("offers", "brand", "product"), ("belongs_to", "product", "category"), ("active_in", "brand", "regional_market")]


@query("select r.source_id, r.target_id, r.relation_type from relations r join entities s on s.id = source_id join entities t on t.id = target_id where not ((relation_type = 'offers' and s.type = 'brand' and t.type = 'product') or (relation_type = 'belongs_to' and s.type = 'product' and t.type = 'category') or (relation_type = 'active_in' and s.type = 'brand' and t.type = 'regional_market'))")
def domain_range_violations(spark, d):
    allowed = spark.createDataFrame(ONTOLOGY, "relation_type string, source_type string, target_type string")
    return graph.domain_range(relations(spark, d), entities(spark, d), allowed).select("source_id", "target_id", "relation_type")


@query("select target_id, relation_type, count(*) as n from relations where relation_type in ('offers', 'belongs_to') group by all having count(*) > 1")
def cardinality_violations(spark, d):
    return relations(spark, d).where("relation_type in ('offers', 'belongs_to')").groupBy("target_id", "relation_type").agg(F.count("*").alias("n")).where("n > 1")


@query("select type, lower(trim(name)) as key, count(*) as n from entities group by all having count(*) > 1")
def entity_uniqueness_violations(spark, d):
    return entities(spark, d).groupBy("type", exprs.normalized_name("name").alias("key")).agg(F.count("*").alias("n")).where("n > 1")


# --- snapshots and outbox ---


@query(", old as (select * from entities where updated_at % 3 <> 0), new as (select id, type, upper(name) as name, layer, brand_id, status, updated_at + 1 as updated_at from entities where updated_at % 2 = 0) select * from new union all select * from old where id not in (select id from new)")
def entity_upsert_merge(spark, d):
    e = entities(spark, d)
    return graph.merge_latest(e.where("updated_at % 3 <> 0"), e.where("updated_at % 2 = 0").withColumn("name", F.upper("name")).withColumn("updated_at", F.col("updated_at") + 1), ["id"], "updated_at")


@query(", old as (select id, name, status from entities where updated_at % 3 <> 0), new as (select id, case when updated_at % 5 = 0 then upper(name) else name end as name, status from entities where updated_at % 7 <> 0) select coalesce(n.id, o.id) as id, case when coalesce(n.status = 'active', false) then 'upsert' else 'delete' end as event_type from old o full join new n on o.id = n.id where (coalesce(n.status = 'active', false) and (not coalesce(o.status = 'active', false) or o.name <> n.name)) or (coalesce(o.status = 'active', false) and not coalesce(n.status = 'active', false))")
def snapshot_diff_outbox(spark, d):
    e = entities(spark, d).select("id", "name", "status", "updated_at")
    new = e.where("updated_at % 7 <> 0").withColumn("name", F.when(F.col("updated_at") % 5 == 0, F.upper("name")).otherwise(F.col("name")))
    return graph.snapshot_events(e.where("updated_at % 3 <> 0"), new, "id", ~F.col("o.name").eqNullSafe(F.col("n.name")))


@query("select aggregate_id, arg_max(event_type, (created_at, id)) as event_type, max(created_at) as created_at from outbox group by 1")
def outbox_latest_state(spark, d):
    return graph.latest(outbox(spark, d).select("aggregate_id", "event_type", "created_at", "id"), "aggregate_id", "created_at", "id").drop("id")


@query("select aggregate_type, aggregate_id, event_type, min(id) as id, min(created_at) as created_at from outbox where not processed group by 1, 2, 3")
def outbox_pending_dedupe(spark, d):
    return stream.pending(outbox(spark, d))


@query("select event_type, count(*) as n from (select aggregate_id, arg_max(event_type, (created_at, id)) as event_type from outbox group by 1) group by 1")
def job_status_counts(spark, d):
    return graph.latest(outbox(spark, d).select("aggregate_id", "event_type", "created_at", "id"), "aggregate_id", "created_at", "id").groupBy("event_type").agg(F.count("*").alias("n"))


# --- documents, spans, units, candidates ---


@query("select sha256(coalesce(text, '')) as content_hash, min(doc_id) as doc_id, count(*) as copies from documents group by 1", "")
def document_exact_dedupe(spark, d):
    return table(spark, d, "documents").groupBy(exprs.content_hash(F.coalesce("text", F.lit(""))).alias("content_hash")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query("select doc_id, 'doc_' || left(sha256(doc_id::varchar || chr(31) || coalesce(lang, '')), 20) as id from documents", "")
def stable_ids(spark, d):
    return table(spark, d, "documents").select("doc_id", exprs.stable_id("doc", "doc_id", "lang").alias("id"))


@query("select doc_id, lang, n_chars from documents order by n_chars desc, doc_id limit 100", "")
def list_documents_top100(spark, d):
    return table(spark, d, "documents").orderBy(F.desc("n_chars"), "doc_id").limit(100).select("doc_id", "lang", "n_chars")


@query("select doc_id, line_no, char_start, raw from lines", f"with {LINES}")
def spans_lines(spark, d):
    return parse.lines(table(spark, d, "documents")).select("doc_id", "line_no", "char_start", "raw")


@query("select doc_id, count(*) as spans, sum(length(raw))::bigint as chars from lines group by 1", f"with {LINES}")
def document_counts(spark, d):
    s = parse.spans(table(spark, d, "documents"))
    counts = s.groupBy("doc_id").agg(F.count("*").alias("spans"), F.sum(F.col("char_end") - F.col("char_start")).alias("chars"))
    return counts


@query("select doc_id, floor(0.6 * len(regexp_extract_all(coalesce(text, ''), '[一-鿿]')) + len(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9]+')))::int as tokens from documents", "")
def token_estimate(spark, d):
    return table(spark, d, "documents").select("doc_id", exprs.token_estimate("text").alias("tokens"))


#: Lines of documents joined to units, for SQL.
UNITS_WALK = f"""with recursive {LINES}, est as (select doc_id, row_number() over (partition by doc_id order by line_no) as k, left(trim(raw), 4000) as t from lines),
walk as (select doc_id, k, t as acc, 0 as unit from est where k = 1 union all
 select e.doc_id, e.k, case when floor(0.6 * len(regexp_extract_all(w.acc, '[一-鿿]')) + len(regexp_extract_all(w.acc, '[A-Za-z0-9]+'))) >= 120 then e.t else w.acc || e.t end,
  case when floor(0.6 * len(regexp_extract_all(w.acc, '[一-鿿]')) + len(regexp_extract_all(w.acc, '[A-Za-z0-9]+'))) >= 120 then w.unit + 1 else w.unit end from walk w join est e on e.doc_id = w.doc_id and e.k = w.k + 1)"""


@query("select doc_id, unit::int as unit_no, left(trim(arg_max(acc, k)), 8000) as text, count(*) as spans from walk group by doc_id, unit", UNITS_WALK)
def units_merge(spark, d):
    return parse.units(table(spark, d, "documents")).select("doc_id", "unit_no", "text", F.size("source_span_ids").cast("bigint").alias("spans"))


STATEMENTS = """stm as (select doc_id, left(trim(raw), 4000) as statement_text, row_number() over (partition by doc_id order by line_no) - 1 as order_index from lines),
statements as (select 'stmt_' || left(sha256(doc_id::varchar || chr(31) || statement_text), 20) as statement_id, doc_id, statement_text, min(order_index) as order_index from stm where order_index < 200 and length(trim(statement_text)) >= 8 group by doc_id, statement_text)"""


@query("select statement_id, doc_id, statement_text, order_index::int as order_index from statements", f"with {LINES}, {STATEMENTS}")
def statements_first200(spark, d):
    return parse.statements(table(spark, d, "documents")).select("statement_id", "doc_id", "statement_text", "order_index")


@query(r"select doc_id, v as value from (select doc_id, unnest(regexp_extract_all(coalesce(text, ''), '\b[Vv]\d+(?:\.\d+)+\b|\b\d+\.\d+\.\d+\b')) as v from documents)", "")
def rule_version(spark, d):
    docs = table(spark, d, "documents").withColumn("unit_id", F.lit("whole"))
    return extract.candidates(docs).where("kind = 'version'").select("doc_id", "value")


@query(r"select doc_id, v as value from (select doc_id, unnest(regexp_extract_all(coalesce(text, ''), '\d+(?:\.\d+)?\s*(?:%|％|亿元人民币|亿元|万元|万|亿|美元|元|人|家|个|台|套|项|倍)')) as v from documents)", "")
def rule_numeric(spark, d):
    docs = table(spark, d, "documents").withColumn("unit_id", F.lit("whole"))
    return extract.candidates(docs).where("kind = 'metric'").select("doc_id", "value")


@query(r"select page_id, v as value from (select page_id, unnest(regexp_extract_all(coalesce(url, ''), 'https?://[^\s，。；]+')) as v from pages)", "")
def rule_url(spark, d):
    pages = table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), F.lit("url").alias("unit_id"), F.col("url").alias("text"))
    return extract.candidates(pages).where("kind = 'url'").select(F.col("doc_id").alias("page_id"), "value")


def _rule_sql(k: int, kind: str, pattern: str, confidence: float, method: str) -> str:
    """Rows of one rule's matches in units; Java's white space of any script is written as RE2's."""
    p = pattern.replace(r"(?U:\s)", r"\s").replace("'", "''")
    return f"select doc_id, unit_id, {k} as r, i, regexp_extract_all(text, '{p}')[i] as value, '{kind}' as kind, {confidence}::double as confidence, '{method}' as method from unit_texts, unnest(generate_series(1, len(regexp_extract_all(text, '{p}')))) as t(i)"


def _trigger_sql(k: int, name: str, pattern: str) -> str:
    return f"select doc_id, unit_id, {len(extract.RULES) + k}, 1, '{name}', 'relation', 0.6::double, 'regex:trigger:{name}' from unit_texts where regexp_matches(text, '{pattern}')"


@query(
    f""", unit_texts as (select doc_id, 'EU_' || lpad(unit::varchar, 5, '0') as unit_id, left(trim(arg_max(acc, k)), 8000) as text from walk group by doc_id, unit),
 matches as ({" union all ".join([_rule_sql(k, *r) for k, r in enumerate(extract.RULES)] + [_trigger_sql(k, *t) for k, t in enumerate(extract.TRIGGERS)])}),
 placed as (select *, (row_number() over (partition by doc_id, unit_id order by r, i) - 1)::int as ord, case kind when 'certification' then 'statement' when 'version' then 'statement' when 'url' then 'statement' else kind end as candidate_type, 'KC_' || doc_id || '_' || left(sha256(kind || '::' || method || '::' || value), 16) as candidate_id from matches),
 firsts as (select * from (select *, row_number() over (partition by doc_id, unit_id, candidate_id order by ord) as f from placed) where f = 1)
 select doc_id, unit_id, ord, kind, value, confidence, method, candidate_type, candidate_id from (select *, row_number() over (partition by doc_id, unit_id order by ord) as c from firsts) where c <= 12""",
    UNITS_WALK,
)
def candidates_capped(spark, d):
    return extract.capped(extract.candidates(parse.units(table(spark, d, "documents"))))


@query("select lower(regexp_replace(name, '[\\s，,、。;；：:]+', '', 'g')) as key, type, count(*) as members, min(id) as first_id, string_agg(id, ',' order by id) as ids from entities group by 1, 2".replace("\\\\", "\\"))
def entity_resolution(spark, d):
    e = entities(spark, d).withColumn("key", exprs.normalize_name("name"))
    return e.groupBy("key", "type").agg(F.count("*").alias("members"), F.min("id").alias("first_id"), F.array_join(F.array_sort(F.collect_list("id")), ",").alias("ids"))


@query("select l_partkey as subject, max(l_discount) + 0.0 as confidence, count(*) as members, arg_min(l_suppkey, (l_orderkey, l_linenumber)) as object from lineitem group by 1", "")
def candidate_fusion(spark, d):
    c = placed(spark, d, "lineitem").select(F.col("l_partkey").alias("subject"), F.col("l_suppkey").alias("object"), F.col("l_discount").alias("confidence"), "l_orderkey", "l_linenumber", "kg_place", F.col("l_returnflag").alias("method"), F.col("l_suppkey").alias("ref"))
    return gates.fuse(c, "subject", ["l_orderkey", "l_linenumber", "kg_place"], "ref", "method", ["object"]).select("subject", (F.col("confidence") + 0.0).alias("confidence"), "members", "object")


@query("select l_partkey as subject, l_returnflag as predicate, count(*) as members, count(distinct l_suppkey) as objects, count(*) > 1 and count(distinct l_suppkey) > 1 as is_conflict from lineitem group by 1, 2", "")
def gate_grouping_conflict(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_partkey").alias("subject"), F.col("l_returnflag").alias("predicate"), F.col("l_suppkey").cast("string").alias("object"))
    return gates.conflicts(rows, ["subject", "predicate"], "object")


GATE = "select doc_id, quality = 1 as schema_valid, true as type_known, case when toxic = 1 then 0 else 2 end as evidence_count, doc_id % 11 = 0 as is_duplicate, doc_id % 13 = 0 as has_conflict, (doc_id % 100) / 100.0 as confidence from labels"


def _gated(spark, d):
    rows = table(spark, d, "labels").selectExpr("doc_id", "quality = 1 as schema_valid", "true as type_known", "if(toxic = 1, 0, 2) as evidence_count", "doc_id % 11 = 0 as is_duplicate", "doc_id % 13 = 0 as has_conflict", "cast((doc_id % 100) / 100.0 as decimal(4,3)) as confidence")
    return gates.gates(rows).withColumn("disposition", gates.disposition())


@query(f"select doc_id, schema_valid as gate_schema, evidence_count > 0 as gate_evidence, not is_duplicate as gate_duplicate, not has_conflict as gate_conflict, confidence >= 0.75 as gate_confidence, case when schema_valid and evidence_count > 0 and not is_duplicate and not has_conflict and confidence >= 0.75 then 'promote' when is_duplicate or has_conflict or confidence < 0.75 then 'review' else 'reject' end as disposition from ({GATE})", "")
def gate_evaluation(spark, d):
    return _gated(spark, d).select("doc_id", "gate_schema", "gate_evidence", "gate_duplicate", "gate_conflict", "gate_confidence", "disposition")


@query(f"select case when schema_valid and evidence_count > 0 and not is_duplicate and not has_conflict and confidence >= 0.75 then 'promote' when is_duplicate or has_conflict or confidence < 0.75 then 'review' else 'reject' end as disposition, count(*) as n from ({GATE}) group by 1", "")
def gate_disposition(spark, d):
    return _gated(spark, d).groupBy("disposition").agg(F.count("*").alias("n"))


@query("select o_orderkey, o_custkey from orders where o_custkey not in (select c_custkey from customer where c_mktsegment <> 'BUILDING')", "")
def fk_violations(spark, d):
    return gates.dangling(table(spark, d, "orders"), "o_custkey", table(spark, d, "customer").where("c_mktsegment <> 'BUILDING'"), "c_custkey").select("o_orderkey", "o_custkey")


@query("select event_id, event_type from events where event_type not in ('click', 'view', 'purchase')", "")
def enum_violations(spark, d):
    return table(spark, d, "events").where(~F.col("event_type").isin("click", "view", "purchase")).select("event_id", "event_type")


ALLOWED = [("signup", "view"), ("view", "click"), ("click", "purchase"), ("click", "view"), ("purchase", "view")]


@query("select event_id, user_id, before, event_type from (select *, lag(event_type) over (partition by user_id order by ts, event_id) as before from events) where before <> event_type and before || '>' || event_type not in ('signup>view', 'view>click', 'click>purchase', 'click>view', 'purchase>view')", "")
def lifecycle_illegal_transitions(spark, d):
    return gates.illegal_transitions(table(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type", ALLOWED).select("event_id", "user_id", "before", "event_type")


@query("select doc_id, t.label as warning_type, count(*) as hits from (select doc_id, lower(coalesce(text, '')) as low from documents), (values ('financial_kpi', 'roi'), ('certification_claim', 'iso')) t(label, m) where contains(low, m) group by 1, 2", "")
def sensitive_scan(spark, d):
    return extract.risks(table(spark, d, "documents")).select("doc_id", "warning_type", F.col("hits").cast("bigint").alias("hits"))


# --- retrieval ---


@query("""select * from (select 'entity' as kind, id, name as text from entities where name ilike '%red%' or type ilike '%red%' order by updated_at desc, id limit 20)
 union all select * from (select 'statement', statement_id, statement_text from statements where statement_text ilike '%red%' order by doc_id, order_index, statement_id limit 20)""", f"{WITH}, {LINES}, {STATEMENTS}")
def search_plain(spark, d):
    return retrieve.search(entities(spark, d), parse.statements(table(spark, d, "documents")), "red", 20)


@query("select id, type, name from entities where status = 'active' and type in ('product', 'brand') and (brand_id = 'brand_Brand#12' or (type = 'brand' and name = 'brand_Brand#12'))")
def search_scoped(spark, d):
    return retrieve.scoped(entities(spark, d), ["product", "brand"], "brand_Brand#12").select("id", "type", "name")


@query("""select * from (select 'entity' as kind, id from entities where status = 'active' order by updated_at desc, id limit 10) union all select * from (select 'relation', source_id || '>' || target_id from relations order by created_at desc, source_id, target_id limit 5)
 union all select * from (select 'statement', statement_id from statements order by doc_id, order_index limit 5)""", f"{WITH}, {LINES}, {STATEMENTS}")
def workspace_overview(spark, d):
    return retrieve.overview(entities(spark, d), relations(spark, d), parse.statements(table(spark, d, "documents")), 20)


@query("select kind, id, min(q)::int as query_no from (select 'entity' as kind, id, 0 as q from entities where name ilike '%red%' union all select 'entity', id, 1 from entities where name ilike '%e%' and type = 'brand') group by 1, 2")
def multi_query_merge(spark, d):
    e = entities(spark, d)
    hits = e.where(F.col("name").ilike("%red%")).select(F.lit("entity").alias("kind"), "id", F.lit(0).alias("query_no"), F.lit(0).alias("rank")).unionByName(e.where(F.col("name").ilike("%e%") & (F.col("type") == "brand")).select(F.lit("entity").alias("kind"), "id", F.lit(1).alias("query_no"), F.lit(0).alias("rank")))
    return retrieve.merge_hits(hits, 1 << 30).select("kind", "id", "query_no")


@query(""", walk_units as (select doc_id, unit, min(k) as a, max(k) as b from walk group by doc_id, unit), placed as (select doc_id, row_number() over (partition by doc_id order by line_no) as k, char_start, char_start + length(raw) as char_end from lines)
 select u.doc_id as item, u.doc_id, 'EU_' || lpad(unit::varchar, 5, '0') as unit_id, min(char_start)::bigint as char_start, max(char_end)::bigint as char_end from walk_units u join placed p on p.doc_id = u.doc_id and p.k between u.a and u.b group by u.doc_id, unit""", UNITS_WALK)
def citations_resolve(spark, d):
    """Every unit of every document as a reference, resolved to its place; documents are parsed once."""
    u = materialise(parse.units(table(spark, d, "documents")).select("doc_id", "unit_id", "char_start", "char_end"), "units")
    return retrieve.citations(u.select(F.col("doc_id").alias("item"), "doc_id", "unit_id"), u, None, 1 << 30).withColumns({c: F.col(c).cast("long") for c in ("char_start", "char_end")})


@query("select query_id, vec_id, similarity, k::int as k from (select *, row_number() over (partition by query_id order by similarity desc, vec_id) as k from (select q.vec_id as query_id, v.vec_id, round(list_cosine_similarity(v.embedding::double[], q.embedding::double[]), 6) as similarity from embeddings v, embeddings q where q.vec_id % 20 = 0 and v.vec_id <> q.vec_id)) where k <= 5", "")
def vector_topk(spark, d):
    v = table(spark, d, "embeddings")
    return retrieve.nearest(v, v.where("vec_id % 20 = 0"), 5)


# --- statistics, market and governance analytics ---


@query("select (select count(*) from entities) as entities, (select count(*) from relations) as relations, (select count(*) from documents) as documents")
def stats_counts(spark, d):
    one = lambda df, n: df.agg(F.count("*").alias(n))
    return one(entities(spark, d), "entities").crossJoin(one(relations(spark, d), "relations")).crossJoin(one(table(spark, d, "documents"), "documents"))


@query("select layer, status, count(*) as n from entities group by 1, 2")
def layer_counts(spark, d):
    return entities(spark, d).groupBy("layer", "status").agg(F.count("*").alias("n"))


@query("select count(*) filter (status = 'active') as active, count(*) filter (status = 'deprecated') as deprecated, round(count(*) filter (status = 'deprecated') / count(*), 4) as rate from entities")
def duplicate_rate(spark, d):
    c = entities(spark, d).agg(F.count_if(F.col("status") == "active").alias("active"), F.count_if(F.col("status") == "deprecated").alias("deprecated"))
    return c.withColumn("rate", exprs.duplicate_rate(F.col("deprecated"), F.col("active")))


@query("select relation_type, count(*) as n, count(*) filter (source_id in (select id from entities) and target_id in (select id from entities)) as projected from relations group by 1")
def consistency_counts(spark, d):
    r = relations(spark, d)
    whole = r.groupBy("relation_type").agg(F.count("*").alias("n"))
    return whole.join(graph.induced(r, entities(spark, d)).groupBy("relation_type").agg(F.count("*").alias("projected")), "relation_type", "left").withColumn("projected", F.coalesce("projected", F.lit(0)).cast("bigint"))


@query("select l_partkey, l_suppkey, n, round(hi / lo - 1, 6) as spread, hi / lo - 1 > 0.2 as is_conflict from (select l_partkey, l_suppkey, count(*) as n, min(l_extendedprice / l_quantity) as lo, max(l_extendedprice / l_quantity) as hi from lineitem group by 1, 2) where n >= 2 and lo > 0", "")
def value_conflict_20pct(spark, d):
    rows = table(spark, d, "lineitem").withColumn("price", F.col("l_extendedprice") / F.col("l_quantity"))
    return gates.value_conflicts(rows, ["l_partkey", "l_suppkey"], "price").select("l_partkey", "l_suppkey", "n", F.round(F.col("hi") / F.col("lo") - 1, 6).alias("spread"), "is_conflict")


IV = "iv as (select l_partkey, l_suppkey, l_orderkey, l_linenumber, l_shipdate as valid_from, lead(l_shipdate) over (partition by l_partkey, l_suppkey order by l_shipdate, l_orderkey, l_linenumber) as valid_to from lineitem)"


def _intervals(spark, d):
    w = Window.partitionBy("l_partkey", "l_suppkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber")
    return table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", F.col("l_shipdate").alias("valid_from"), F.lead("l_shipdate").over(w).alias("valid_to"))


@query("select l_orderkey, l_linenumber from iv where valid_from <= timestamp '1996-06-01' and (valid_to is null or valid_to >= timestamp '1996-06-01')", f"with {IV}")
def validity_filter(spark, d):
    return _intervals(spark, d).where(gates.valid_at(F.expr("timestamp_ntz'1996-06-01'"), F.col("valid_from"), F.col("valid_to"))).select("l_orderkey", "l_linenumber")


@query("select user_id, event_type, count(*) as n, date_diff('day', min(ts), max(ts))::int as days, count(*) >= 3 and date_diff('day', min(ts), max(ts)) >= 7 as is_fact from events group by 1, 2", "")
def observation_promotion(spark, d):
    g = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.datediff(F.max("ts"), F.min("ts")).alias("days"))
    return g.withColumn("is_fact", (F.col("n") >= 3) & (F.col("days") >= 7))


REV = "rev as (select n_name, year(o_orderdate) as y, sum(round(o_totalprice * 100)::bigint) as cents from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by 1, 2)"


def _revenue(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return o.groupBy("n_name", F.year("o_orderdate").cast("bigint").alias("y")).agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("cents"))


@query("select n_name, y, round(cents / sum(cents) over (partition by y), 6) as share from rev", f"with {REV}")
def market_share(spark, d):
    total = F.sum("cents").over(Window.partitionBy("y"))
    return _revenue(spark, d).select("n_name", "y", F.round(F.col("cents") / total, 6).alias("share"))


@query(", sh as (select y, cents / sum(cents) over (partition by y) as s, row_number() over (partition by y order by cents desc, n_name) as k from rev) select y, round(sum(s) filter (k <= 4), 6) as cr4, round(sum(s * s), 6) as hhi from sh group by y", f"with {REV}")
def concentration_cr4_hhi(spark, d):
    w = Window.partitionBy("y")
    s = _revenue(spark, d).withColumn("s", F.col("cents") / F.sum("cents").over(w)).withColumn("k", F.row_number().over(w.orderBy(F.desc("cents"), "n_name")))
    return s.groupBy("y").agg(F.round(F.sum(F.when(F.col("k") <= 4, F.col("s"))), 6).alias("cr4"), F.round(F.sum(F.col("s") * F.col("s")), 6).alias("hhi"))


@query("select n_name, y, round(cents / lag(cents) over (partition by n_name order by y) - 1, 6) as growth from rev", f"with {REV}")
def growth_rate(spark, d):
    return _revenue(spark, d).select("n_name", "y", F.round(F.col("cents") / F.lag("cents").over(Window.partitionBy("n_name").orderBy("y")) - 1, 6).alias("growth"))


@query("select p_brand, round(avg(p_retailprice) / (select avg(p_retailprice) from part), 6) as price_index from part group by 1", "")
def price_index(spark, d):
    p = table(spark, d, "part")
    return p.groupBy("p_brand").agg(F.avg("p_retailprice").alias("a")).crossJoin(p.agg(F.avg("p_retailprice").alias("m"))).select("p_brand", F.round(F.col("a") / F.col("m"), 6).alias("price_index"))


@query("select lang, round(count(*) / (select count(*) from documents), 6) as share from documents group by 1", "")
def share_of_voice(spark, d):
    docs = table(spark, d, "documents")
    return docs.groupBy("lang").agg(F.count("*").alias("n")).crossJoin(docs.agg(F.count("*").alias("m"))).select("lang", F.round(F.col("n") / F.col("m"), 6).alias("share"))


@query("select p_type, count(distinct l_suppkey) as suppliers, count(distinct l_suppkey) < 3 as is_gap from part left join lineitem on p_partkey = l_partkey and l_quantity > 49 group by 1", "")
def coverage_gap(spark, d):
    l = table(spark, d, "lineitem").where("l_quantity > 49")
    g = table(spark, d, "part").join(l, F.col("p_partkey") == F.col("l_partkey"), "left").groupBy("p_type").agg(F.count_distinct("l_suppkey").alias("suppliers"))
    return g.withColumn("is_gap", F.col("suppliers") < 3)


@query("select user_id, max(ts) as last_seen, date_diff('day', max(ts), timestamp '2024-01-31')::int as age, date_diff('day', max(ts), timestamp '2024-01-31') > 3 as stale from events group by 1", "")
def staleness(spark, d):
    g = table(spark, d, "events").groupBy("user_id").agg(F.max("ts").alias("last_seen"))
    return g.withColumn("age", F.datediff(F.lit("2024-01-31").cast("date"), "last_seen")).withColumn("stale", F.col("age") > 3)


@query("select conv_id, count(*) filter (role = 'user') as users, count(*) filter (role = 'assistant') as assistants, count(*) filter (role = 'user') = count(*) filter (role = 'assistant') as complete from conversations group by 1", "")
def chat_exchange_complete(spark, d):
    g = table(spark, d, "conversations").groupBy("conv_id").agg(F.count_if(F.col("role") == "user").alias("users"), F.count_if(F.col("role") == "assistant").alias("assistants"))
    return g.withColumn("complete", F.col("users") == F.col("assistants"))


@query("select source, count(*) as n from documents where source = 'src1' group by 1", "")
def tenant_isolation(spark, d):
    return table(spark, d, "documents").where(F.col("source") == "src1").groupBy("source").agg(F.count("*").alias("n"))


@query("select page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) as host from pages where regexp_matches(regexp_extract(url, '^https?://([^/?#]+)', 1), '(^|\\.)(casino-win|free-bets|cheap-pills)\\.example\\.com$')", "")
def domain_blacklist(spark, d):
    host = F.regexp_extract("url", r"^https?://([^/?#]+)", 1)
    return table(spark, d, "pages").select("page_id", host.alias("host")).where(F.col("host").rlike(r"(^|\.)(casino-win|free-bets|cheap-pills)\.example\.com$"))


@query("select time_bucket(interval '1 hour', ts) as window_start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2", "")
def window_tumbling(spark, d):
    return stream.tumbling(table(spark, d, "events"), "1 hour")


@query("select user_id, min(ts) as session_start, count(*) as n from (select *, sum(new) over (partition by user_id order by ts, event_id) as s from (select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval '30 minutes' then 0 else 1 end as new from events)) group by user_id, s", "")
def session_windows(spark, d):
    return stream.sessions(table(spark, d, "events"), "30 minutes")


# --- governance, versions and keyed writes ---


@query("""recursive v as (select o_orderkey, lag(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey) as prev from orders),
 c as (select o_orderkey, o_orderkey as root, 0::bigint as depth from v where prev is null union all select v.o_orderkey, c.root, c.depth + 1 from v join c on v.prev = c.o_orderkey)
 select o_orderkey, root, depth from c""", "with")
def supersedes_chain(spark, d):
    prev = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return governance.chains(table(spark, d, "orders").select("o_orderkey", prev.alias("prev")), "o_orderkey", "prev")


@query("select doc_id, (row_number() over (partition by doc_id order by line_no) - 1)::int as order_index, char_start::bigint as char_start, (char_start + length(raw))::bigint as char_end from lines", f"with {LINES}")
def spans_offsets(spark, d):
    return parse.spans(table(spark, d, "documents")).select("doc_id", F.col("order_index").cast("int").alias("order_index"), F.col("char_start").cast("long").alias("char_start"), F.col("char_end").cast("long").alias("char_end"))


@query("""select doc_id, case when regexp_matches(raw, '^#{1,6}\\s+[^#\\s]') then 'heading' when regexp_matches(raw, '^\\s*([-*+]|[0-9]+[.)])\\s+.') then 'list_item' else 'paragraph' end as span_type, count(*) as n from lines group by 1, 2""", f"with {LINES}")
def spans_classified(spark, d):
    return parse.spans(table(spark, d, "documents")).groupBy("doc_id", "span_type").agg(F.count("*").alias("n"))


@query("""select a.l_partkey, a.l_suppkey, a.id as first_id, b.id as second_id from f a join f b on a.l_partkey = b.l_partkey and a.l_suppkey = b.l_suppkey and a.id < b.id
 and a.l_quantity <> b.l_quantity and a.l_shipdate <= b.l_shipdate + interval 90 day and b.l_shipdate <= a.l_shipdate + interval 90 day""",
 "with f as (select l_partkey, l_suppkey, l_orderkey * 10 + l_linenumber as id, l_quantity, l_shipdate from lineitem)")
def interval_overlap(spark, d):
    facts = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "l_quantity", "l_shipdate", (F.col("l_shipdate") + F.expr("interval 90 days")).alias("valid_to"))
    return governance.overlaps(facts, ["l_partkey", "l_suppkey"], "id", "l_quantity", "l_shipdate", "valid_to")


SCORES = {"authority": "s_suppkey % 5 + 1", "independence": "s_suppkey % 4 + 1", "methodology": "s_nationkey % 5 + 1", "timeliness": "s_nationkey % 3 + 1", "transparency": "s_suppkey % 3 + 2"}


@query("select s_suppkey, score, score < 3 as needs_review from (select s_suppkey, (30 * (s_suppkey % 5 + 1) + 25 * (s_suppkey % 4 + 1) + 25 * (s_nationkey % 5 + 1) + 10 * (s_nationkey % 3 + 1) + 10 * (s_suppkey % 3 + 2)) / 100 as score from supplier)", "")
def source_quality_score(spark, d):
    return governance.source_quality(table(spark, d, "supplier").selectExpr("s_suppkey", *[f"{e} as {c}" for c, e in SCORES.items()])).select("s_suppkey", "score", "needs_review")


KINDS = [k for k, _, _ in governance.SUFFICIENT]


@query("select o_orderkey, kind, sources, high_sources, sources >= l and high_sources >= h as sufficient from g join (values " + ", ".join(f"('{k}', {n}, {h})" for k, n, h in governance.SUFFICIENT) + ") r(kind, l, h) using (kind)",
 "with g as (select o_orderkey, (['" + "', '".join(KINDS) + "'])[(o_orderkey % 7 + 1)::int] as kind, count(distinct l_suppkey) as sources, count(distinct case when s_acctbal > 5000 then l_suppkey end) as high_sources from orders join lineitem on o_orderkey = l_orderkey join supplier on l_suppkey = s_suppkey group by 1, 2)")
def evidence_sufficiency(spark, d):
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("o_orderkey") % 7 + 1).cast("int")).alias("kind")
    refs = table(spark, d, "orders").select("o_orderkey", kind).join(table(spark, d, "lineitem").select("l_orderkey", "l_suppkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    refs = refs.join(table(spark, d, "supplier").select("s_suppkey", "s_acctbal"), F.col("l_suppkey") == F.col("s_suppkey"))
    return governance.sufficiency(refs, "o_orderkey", "kind", "l_suppkey", F.col("s_acctbal") > 5000)


@query("select l_partkey, l_suppkey, string_agg(distinct l_orderkey::varchar, ',' order by l_orderkey::varchar) as refs, min(l_shipdate) as created_at, max(l_shipdate) as updated_at from lineitem group by 1, 2", "")
def same_fact_merge(spark, d):
    rows = table(spark, d, "lineitem").withColumn("ref", F.col("l_orderkey").cast("string"))
    return governance.same_facts(rows, ["l_partkey", "l_suppkey"], "ref", "l_shipdate", "l_shipdate").withColumn("refs", F.array_join("refs", ","))


@query("select c_nationkey, round(count(distinct o_custkey) / count(distinct c_custkey), 6) as penetration_rate from customer left join orders on c_custkey = o_custkey group by 1", "")
def penetration_rate(spark, d):
    buyers = table(spark, d, "orders").select("o_custkey").distinct()
    g = table(spark, d, "customer").join(buyers, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_nationkey")
    return g.agg(F.round(F.count("o_custkey") / F.count("*"), 6).alias("penetration_rate"))


@query("select count(*) filter (o.k is null) as added, count(*) filter (o.v <> n.v) as updated, count(*) filter (n.k is null) as deprecated, count(o.k) as before, count(n.k) as after from o full join n on o.k = n.k",
 "with o as (select o_orderkey as k, o_totalprice as v from orders where o_orderkey % 10 <> 0), n as (select o_orderkey as k, case when o_orderkey % 7 = 0 then o_totalprice + 1 else o_totalprice end as v from orders where o_orderkey % 10 <> 1)")
def snapshot_change_report(spark, d):
    orders = table(spark, d, "orders").selectExpr("o_orderkey as k", "o_totalprice as v")
    new = orders.where("k % 10 <> 1").withColumn("v", F.when(F.col("k") % 7 == 0, F.col("v") + 1).otherwise(F.col("v")))
    return governance.changes(orders.where("k % 10 <> 0"), new, "k", F.col("o.v") != F.col("n.v"))


@query("select c_nationkey, c_custkey, place from (select *, row_number() over (partition by c_nationkey order by authority, c_acctbal desc, valid_to nulls first, c_custkey)::int as place from a) where place <= 3",
 "with a as (select c_nationkey, c_custkey, c_acctbal, length(c_mktsegment) as authority, nullif(c_custkey % 4, 0) as valid_to from customer)")
def authority_ranking(spark, d):
    rows = table(spark, d, "customer").selectExpr("c_nationkey", "c_custkey", "c_acctbal", "length(c_mktsegment) as authority", "nullif(c_custkey % 4, 0) as valid_to")
    return governance.ranked(rows, "c_nationkey", "authority", "c_acctbal", "valid_to", "c_custkey", 3).select("c_nationkey", "c_custkey", "place")


@query("select distinct l_orderkey, l_linenumber::varchar as marker, l_quantity > 10 as resolved from (select l_orderkey, l_linenumber, max(l_quantity) as l_quantity from lineitem group by 1, 2)", "")
def citation_markers(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("marker"), "l_quantity")
    reports = lines.groupBy("l_orderkey").agg(F.array_join(F.collect_list(F.concat(F.lit("as stated [S"), "marker", F.lit("]"))), "; ").alias("text"))
    return governance.markers(reports, "l_orderkey", "text", lines.where("l_quantity > 10"))


@query()
def near_duplicate(spark, d):
    parts = table(spark, d, "part").selectExpr("p_partkey", "p_name")
    return governance.near_duplicates(parts, parts.where("p_partkey % 10 <> 0"), "p_partkey", "p_name", "p_partkey")


@query("""select 'customer' as target_type, o.id as target_id, 'promotion' as review_type, o.tenant as tenant_id, case when o.status = 'pending' and n.id is not null then 8 else o.priority end as priority,
 case when o.status = 'pending' and n.id is not null then n.reason else 'old' end as reason, o.status from o left join n on o.id = n.id
 union all select 'customer', n.id, 'promotion', n.tenant, 8, n.reason, 'pending' from n where n.id not in (select id from o where status = 'pending')""",
 "with o as (select c_custkey as id, c_nationkey as tenant, 3 as priority, case when c_custkey % 2 = 0 then 'pending' else 'done' end as status from customer where c_custkey % 3 = 0), n as (select c_custkey as id, c_nationkey as tenant, c_mktsegment as reason from customer where c_custkey % 4 = 0)")
def review_queue_upsert(spark, d):
    c = table(spark, d, "customer").withColumns({"target_type": F.lit("customer"), "review_type": F.lit("promotion"), "target_id": F.col("c_custkey"), "tenant_id": F.col("c_nationkey")})
    old = c.where("c_custkey % 3 = 0").selectExpr("target_type", "target_id", "review_type", "tenant_id", "3 as priority", "'old' as reason", "if(c_custkey % 2 = 0, 'pending', 'done') as status")
    new = c.where("c_custkey % 4 = 0").selectExpr("target_type", "target_id", "review_type", "tenant_id", "8 as priority", "c_mktsegment as reason", "c_custkey as ord")
    return upsert.queue_reviews(old, new, "ord")


@query("select doc_id, case when doc_id % 2 <> 0 then 'inserted' when doc_id % 3 = 0 then 'updated' else 'skipped' end as action from documents", "")
def register_documents(spark, d):
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, d, "documents").select("doc_id", text.alias("text"))
    known = docs.where("doc_id % 2 = 0").select(F.col("doc_id").alias("source_id"), exprs.content_hash("text").alias("content_hash"))
    changed = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    new = docs.select("doc_id", F.col("doc_id").alias("source_id"), exprs.content_hash(changed).alias("content_hash"))
    return upsert.registered(known, new).select("doc_id", "action")
