"""Queries of writes over time: folds of many documents, projections, versions, rules and tenants, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from kgspark.functions import exprs
from kgspark.operators import extract, governance, graph, models, reads, rule_tables, similar, snapshots, store, templates, tenants
from kgspark.plans import knowledge
from kgspark.plans.catalog import query
from kgspark.session import Scratch, materialise
from kgspark.sources.fixtures import entities, placed, table
from kgspark.streaming import projector

#: Lines of orders as mentions of suppliers: an order is a document, suppliers with an even key are in the store already (with a repeated source), those of key 0 to 4 mod 25 are never mentioned.
MENTIONS = "mentions as (select 's' || l_suppkey as id, l_orderkey as doc, l_linenumber as line, 'n' || l_partkey as name, 'd' || (l_orderkey % 40) as src, 'b' || (l_partkey % 5) as alias, 'r' || l_linenumber as ref, l_returnflag as k, 'v' || l_orderkey || '/' || l_linenumber as v from lineitem where l_suppkey % 25 > 4)"
HELD = "held as (select 's' || s_suppkey as id, 'old' as name, 'organization' as type, s_nationkey as n from supplier where s_suppkey % 2 = 0)"


@query("""select coalesce(h.id, m.id) as id, coalesce(m.name, h.name) as name, coalesce(h.type, 'mention') as type, coalesce(s.sources, 'd' || n || ',d7,d7') as sources, coalesce(a.aliases, 'x') as aliases, coalesce(r.refs, '') as refs, coalesce(c.scalars, 'R=old') as scalars
from held h full join (select id, arg_max(name, doc * 10 + line) as name from mentions group by id) m on h.id = m.id
left join (select id, string_agg(x, ',' order by o) as sources from (select id, x, min(o) as o from (select id, src as x, doc * 10 + line as o from mentions union all select id, 'd' || n, -2 from held union all select id, 'd7', -1 from held) group by id, x) where id in (select id from mentions) group by id) s on s.id = coalesce(h.id, m.id)
left join (select id, string_agg(x, ',' order by o) as aliases from (select id, x, min(o) as o from (select id, alias as x, doc * 10 + line as o from mentions union all select id, 'x', -1 from held) group by id, x) where id in (select id from mentions) group by id) a on a.id = coalesce(h.id, m.id)
left join (select id, string_agg(x, ',' order by o) as refs from (select id, ref as x, min(doc * 10 + line) as o from mentions group by id, ref) group by id) r on r.id = coalesce(h.id, m.id)
left join (select id, string_agg(k || '=' || v, ',' order by k) as scalars from (select id, k, arg_max(v, o) as v from (select id, k, v, doc * 10 + line as o from mentions union all select id, 'R', 'old', -1 from held) group by id, k) where id in (select id from mentions) group by id) c on c.id = coalesce(h.id, m.id)""", f"with {MENTIONS}, {HELD}")
def document_fold(spark, d):
    s = table(spark, d, "supplier").where("s_suppkey % 2 = 0")
    props = "struct(map('R', 'old') as scalars, cast(null as string) as source_document_id, array('d' || s_nationkey, 'd7', 'd7') as source_document_ids, array('x') as aliases, cast(array() as array<string>) as evidence_refs)"
    old = s.selectExpr("'s' || s_suppkey as id", "'old' as name", "'organization' as type", f"{props} as properties")
    props = "struct(map(l_returnflag, 'v' || l_orderkey || '/' || l_linenumber) as scalars, 'd' || (l_orderkey % 40) as source_document_id, cast(null as array<string>) as source_document_ids, array('b' || (l_partkey % 5)) as aliases, array('r' || l_linenumber) as evidence_refs)"
    mentions = placed(spark, d, "lineitem").where("l_suppkey % 25 > 4").selectExpr("'s' || l_suppkey as id", "'n' || l_partkey as name", "'mention' as type", f"{props} as properties", "l_orderkey as doc", "l_linenumber as line", "kg_place")
    p = store.fold_entities(old, mentions, ["doc", "line"], place="kg_place").select("id", "name", "type", "properties.*")
    pairs = F.transform(F.array_sort(F.map_entries("scalars")), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return p.select("id", "name", "type", F.array_join("source_document_ids", ",").alias("sources"), F.array_join("aliases", ",").alias("aliases"), F.array_join("evidence_refs", ",").alias("refs"), F.array_join(pairs, ",").alias("scalars"))


@query()
def near_statements(spark, d):
    """Lines of documents as statements about the line's first word: SQL has no such similarity, so tests compare with brute force."""
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "line"))
    statements = lines.select(F.concat_ws("/", "doc_id", "line_no").alias("id"), F.regexp_extract(F.lower("line"), r"^\S+", 0).alias("subject"), "line")
    return similar.similar_statements(statements, "subject", "id", "line")[0]


#: Orders as chains of nodes: an order is of the template number o_orderkey % 10, it and its lines have the types of that template in turn; some lines also lead to the next order of the template.
_NAMES = sorted(templates.CHAINS)
_TYPES = "case " + " ".join(f"when o % 10 = {k} and p = {i} then '{t}'" for k, n in enumerate(_NAMES) for i, t in enumerate(templates.CHAINS[n])) + " else 'other' end"
_POINTS = "select l_orderkey as o, l_linenumber as p from lineitem union select distinct l_orderkey, 0 from lineitem"
GRAPH = f"""typed as (select concat(o, '_', p) as id, {_TYPES} as type, o, p from ({_POINTS}) x),
 links as (select concat(o, '_', p) as source_id, concat(o, '_', p + 1) as target_id from typed union all select concat(o, '_', p + 1), concat(o + 10, '_', p + 2) from typed where p % 3 = 1),
 ways as (select distinct u, v from (select source_id as u, target_id as v from links union all select target_id, source_id from links) w join typed a on a.id = u join typed b on b.id = v)"""


def _template_sql(name: str) -> str:
    types = templates.CHAINS[name]
    joins = "".join(f" join ways w{k} on w{k}.u = n{k - 1}.id join typed n{k} on n{k}.id = w{k}.v and n{k}.type = '{t}'" for k, t in enumerate(types) if k)
    ids = ", '>', ".join(f"n{k}.id" for k in range(len(types)))
    return f"select '{name}' as template, concat({ids}) as path from typed n0{joins} where n0.type = '{types[0]}'"


@query(" union all ".join(map(_template_sql, _NAMES)), f"with {GRAPH}")
def template_paths(spark, d):
    table(spark, d, "lineitem").select("l_orderkey", "l_linenumber").createOrReplaceTempView("kg_lineitem")
    kinds = spark.sql(f"select concat(o, '_', p) as id, {_TYPES} as type, o, p from ({_POINTS.replace('lineitem', 'kg_lineitem')})")
    with Scratch(spark, "points") as w:
        kinds = w.write(kinds, "points")
        cross = F.when(F.col("p") % 3 == 1, F.expr("named_struct('source_id', concat(o, '_', p + 1), 'target_id', concat(o + 10, '_', p + 2))"))
        links = kinds.select(F.inline(F.array_compact(F.array(F.expr("named_struct('source_id', concat(o, '_', p), 'target_id', concat(o, '_', p + 1))"), cross))))
        return templates.template_paths(kinds.select("id", "type"), links).select("template", F.array_join("path", ">").alias("path"))


#: Two snapshots of lines as assertions: of every 13 lines some change their text, state, note or place in a chain.
_ASSERTION = "l_orderkey * 10 + l_linenumber as id, 't' || l_suppkey % 3 as tenant_id, 'b' || l_partkey % 7 as brand_id, 's' || l_orderkey as subject_id, 'p' as predicate, cast(null as varchar(9)) as object_entity_id, cast(l_quantity as int) as object_value"
_OLD = f"select {_ASSERTION}, 'text' as statement_text, case when l_linenumber > 1 then l_orderkey * 10 + l_linenumber - 1 end as supersedes_id, case l_returnflag when 'N' then 'candidate' else 'active' end as status, 'n' as note, l_orderkey % 13 as k from lines1"
_NEW = f"""select {_ASSERTION}, case when l_orderkey % 13 = 1 then 'other' else 'text' end as statement_text, case when l_orderkey % 13 = 4 and l_linenumber = 1 then l_orderkey * 10 + 2 when l_orderkey % 13 = 5 and l_linenumber = 3 then l_orderkey * 10 + 1 when l_orderkey % 13 = 6 and l_linenumber = 2 then -1 when l_linenumber > 1 then l_orderkey * 10 + l_linenumber - 1 end as supersedes_id,
 case when l_orderkey % 13 = 2 then 'archived' when l_orderkey % 13 = 3 then 'active' else case l_returnflag when 'N' then 'candidate' else 'active' end end as status, case when l_orderkey % 13 in (1, 7) then 'm' else 'n' end as note, l_orderkey % 13 as k from lines1 where l_orderkey % 13 <> 8"""


_ONE = "lines1 as (select l_orderkey, l_linenumber, min(l_suppkey) as l_suppkey, min(l_partkey) as l_partkey, min(l_quantity) as l_quantity, min(l_returnflag) as l_returnflag from lineitem group by l_orderkey, l_linenumber)"


def _assertions(spark, d, sql):
    table(spark, d, "lineitem").createOrReplaceTempView("kg_lineitem")
    return spark.sql(f"with {_ONE.replace('from lineitem', 'from kg_lineitem')} {sql}").drop("k")


_PAIRS = " ".join(f", case when o.{c} is distinct from n.{c} then '{c}' end as x_{c}" for c in ("statement_text", "supersedes_id", "status", "note"))


@query(f"""select id, reason, case reason when 'frozen' then concat_ws(',', x_supersedes_id, x_statement_text) else concat_ws(',', x_note, x_statement_text, x_status, x_supersedes_id) end as changed from (
 select *, case when concat_ws('', x_statement_text, x_supersedes_id, x_status, x_note) = '' then null when was <> 'candidate' then 'not_candidate' when now not in ('candidate', 'active') then 'illegal_status' when x_statement_text is not null or x_supersedes_id is not null then 'frozen' end as reason
 from (select o.id, o.status as was, n.status as now {_PAIRS} from ({_OLD}) o join ({_NEW}) n on o.id = n.id) x) y where reason is not null""", f"with {_ONE}")
def append_only_violations(spark, d):
    got = governance.append_only_violations(_assertions(spark, d, _OLD), _assertions(spark, d, _NEW))
    order = F.when(F.col("reason") == "frozen", F.reverse(F.array_sort("changed"))).otherwise(F.array_sort("changed"))
    return got.select("id", "reason", F.array_join(order, ",").alias("changed"))


@query(f"""select n.id, 'unknown' as error from n where supersedes_id is not null and supersedes_id not in (select id from n) union all
 select id, 'fork' from n where supersedes_id in (select supersedes_id from n group by 1 having count(*) > 1) union all
 select id, 'cycle' from n where id not in (select id from ok)""",
 f"with recursive {_ONE}, n as ({_NEW}), ok as (select id from n where supersedes_id is null or supersedes_id not in (select id from n) union all select n.id from n join ok on n.supersedes_id = ok.id)")
def chain_errors(spark, d):
    return governance.chain_errors(_assertions(spark, d, _NEW))


# --- rule tables ---

#: Lines as statements; the same text makes them in Spark and DuckDB. Suppliers are sources.
_CLAIMS = """claims as (select o * 10 + n as id, case o % 6 when 0 then 'fact' when 1 then 'fact' when 2 then 'claim' when 3 then 'observation' when 4 then 'inference' end as statement_type, concat('p', p % 200) as subject_id, concat('q', n % 3) as predicate, case when o % 17 <> 0 then concat('v', o % 4) end as object_value,
 case o % 7 when 0 then 'share grew 12 percent' when 1 then 'the best product' when 2 then 'market leader in the whole region' else 'plain words' end as statement_text, case when o % 11 <> 0 then q end as value, case when o % 2 = 0 then 'USD' end as unit, case when o % 3 = 0 then '2024' end as period, case when o % 5 <> 0 then 'EU' end as region,
 case n when 1 then 'market_share' when 2 then 'compliance' when 3 then 'research' when 4 then 'comparison' when 5 then 'product' end as topic, case o % 4 when 0 then 100 when 1 then 300 end as valid_to, case n % 3 when 0 then 'active' when 1 then 'candidate' else 'pending_verification' end as status, (o % 10) / 10.0 as confidence,
 o % 9 = 0 as conflict_marked, case when s % 6 <> 0 then concat('b', s % 5) end as brand_id, case when o % 8 <> 0 then 'i1' end as industry_id, case when o % 19 <> 0 then 'public' end as permission, case when o % 2 = 1 then 'short' end as summary, o, n, s, p from (select l_orderkey as o, l_linenumber as n, l_suppkey as s, l_partkey as p, l_quantity as q from lines1) x),
 refs as (select id, concat('s', s) as source_id from claims where o % 8 <> 0 union all select id, concat('s', s + 1) from claims where o % 3 = 0),
 sources as (select concat('s', s_suppkey) as source_id, case s_suppkey % 9 when 0 then 'official' when 1 then 'community' when 2 then 'academic' when 3 then 'search_observation' when 4 then 'third_party_review' when 5 then 'government_regulatory' when 6 then 'company_disclosure' when 7 then 'media' else 'official' end as source_type, concat('b', s_suppkey % 5) as brand_id, case when s_suppkey % 13 <> 0 then 'u' end as url, s_suppkey % 30 as observed_day from supplier)"""
_WITH_CLAIMS = f"{_ONE}, {_CLAIMS}"


def _of(spark, d, ctes, name):
    """Rows of a name that SQL defines over the driver's tables, which bear names of our own in the session."""
    for t in ("lineitem", "supplier", "documents"):
        if f"from {t}" in ctes:
            table(spark, d, t).createOrReplaceTempView(f"kg_{t}")
            ctes = ctes.replace(f"from {t}", f"from kg_{t}")
    return spark.sql(f"with {ctes} select * from {name}")


def _view(spark, d, name):
    return _of(spark, d, _WITH_CLAIMS, name)


#: Predicates of failing in SQL, over `w`.
_QUALITY_SQL = {
    "rule_fact_001": "f and ns = 0", "rule_fact_002": "f and regexp_matches(t, '[0-9]') and (value is null or unit is null or period is null or region is null)", "rule_fact_003": "f and regexp_matches(t, 'leader|leading|safest') and ns > 0 and own = ns",
    "rule_fact_004": "fc and ((period is not null and valid_to is null) or (valid_to < 200 and status = 'active'))", "rule_source_001": "f and topic in ('market_share', 'comparison') and ns > 0 and ns = off", "rule_source_002": "f and topic = 'compliance' and gov = 0", "rule_source_003": "f and topic = 'research' and aca = 0",
    "rule_source_004": "f and topic = 'market_share' and ns = 1 and tpr = 1", "rule_source_005": "f and ns > 0 and com = ns", "rule_source_006": "status = 'active' and ns > 0 and sea = ns and (views < 3 or days < 7)", "rule_evidence_001": "statement_type is null", "rule_evidence_002": "fc and tra = 0",
    "rule_evidence_003": "fc and regexp_matches(t, 'best|100%') and hi = 0", "rule_evidence_004": "(fc or statement_type = 'observation') and confidence < 0.5 and status <> 'pending_verification'", "rule_quality_001": "f and ns > 0 and hi = 0 and fhi > 0", "rule_quality_002": "f and same > 1",
    "rule_quality_003": "fc and vals > 1 and not conflict_marked", "rule_quality_004": "fc and (topic is null or permission is null or (brand_id is null and industry_id is null))", "rule_quality_005": "f and length(statement_text) > 20 and summary is null",
}
_RULE_ROWS = ", ".join(f"('{r}', '{c}', '{p}')" for r, c, p in rule_tables.QUALITY_RULES)


@query(
    f"""select id, rule, category, priority from ({" union all ".join(f"select id, '{r}' as rule from w where {p}" for r, p in _QUALITY_SQL.items())}) x join (values {_RULE_ROWS}) as v(rule, category, priority) using (rule)""",
    f"""with {_WITH_CLAIMS}, m as (select distinct refs.id, sources.* from refs join sources on sources.source_id = refs.source_id),
 a as (select m.id, count(*) as ns, count(url) as tra, count(*) filter (source_type in ('official', 'company_disclosure')) as off, count(*) filter (source_type in ('official', 'company_disclosure') and m.brand_id = c.brand_id) as own, count(*) filter (source_type in ('official', 'company_disclosure', 'academic', 'government_regulatory')) as hi,
  count(*) filter (source_type = 'government_regulatory') as gov, count(*) filter (source_type = 'academic') as aca, count(*) filter (source_type = 'third_party_review') as tpr, count(*) filter (source_type = 'community') as com, count(*) filter (source_type = 'search_observation') as sea, count(distinct observed_day) as views, max(observed_day) - min(observed_day) as days from m join claims c on c.id = m.id group by m.id),
 z as (select claims.*, coalesce(ns, 0) as ns, coalesce(tra, 0) as tra, coalesce(off, 0) as off, coalesce(own, 0) as own, coalesce(hi, 0) as hi, coalesce(gov, 0) as gov, coalesce(aca, 0) as aca, coalesce(tpr, 0) as tpr, coalesce(com, 0) as com, coalesce(sea, 0) as sea, views, days, lower(statement_text) as t, coalesce(statement_type = 'fact', false) as f, coalesce(statement_type in ('fact', 'claim'), false) as fc from claims left join a on a.id = claims.id),
 w as (select z.*, max(hi) over (partition by subject_id, predicate) as fhi, (select count(distinct y.object_value) from claims y where y.subject_id = z.subject_id and y.predicate = z.predicate) as vals, count(*) over (partition by subject_id, predicate, object_value) as same from z)""",
)
def quality_rule_failures(spark, d):
    with Scratch(spark, "claims") as s:
        # claims and references read the same distinct lines, which are written once
        table(spark, d, "lineitem").createOrReplaceTempView("kg_lineitem")
        one = _ONE.removeprefix("lines1 as (").removesuffix(")").replace("from lineitem", "from kg_lineitem")
        s.write(spark.sql(one), "lines").createOrReplaceTempView("kg_lines1")
        table(spark, d, "supplier").createOrReplaceTempView("kg_supplier")
        view = lambda name: spark.sql(f"with {_CLAIMS.replace('from lines1', 'from kg_lines1').replace('from supplier', 'from kg_supplier')} select * from {name}")
        return rule_tables.quality_failures(view("claims"), view("refs"), view("sources"), F.lit(200))


_CANDS = """cands as (select id, case when o % 23 <> 0 then concat('i', o % 4) else 'none' end as industry_id, subject_id, predicate, case when o % 12 = 0 then 'gone' else concat('p', (p + 1) % 200) end as object_id, brand_id, statement_type as statement_class,
 case when o % 10 = 0 then '' when o % 10 < 6 then concat('Name ', p % 200, '; name ', (p + 1) % 200, ';') else concat('name ', p % 200, ';') end as evidence_text, case when o % 21 = 0 then 'search_snippets' end as evidence_kind, period as valid_from, region, o, p from claims),
 ents as (select concat('p', k) as id, case k % 3 when 0 then 'product' when 1 then 'brand' else 'category' end as type, concat('NAME ', k, ';') as name from (select distinct l_partkey % 200 as k from lineitem) x where k % 31 <> 0),
 onto as (select 'q0' as relation_type, 'product' as source_type, 'brand' as target_type union all select 'q1', 'brand', 'category' union all select 'q2', 'category', 'product' union all select 'q1', 'product', 'brand'),
 inds as (select concat('i', r_regionkey) as industry_id from (select distinct o % 3 as r_regionkey from claims) x),
 act as (select subject_id, predicate, object_id from cands where o % 4 = 0)"""


@query(
    """select id, case when industry_scope then 'fail_with_rejection' when entity_types then 'fail_with_rejection' when relation_valid then 'fail_with_rejection' when traceable_source then 'fail_with_retry' when original_evidence then 'fail_with_retry' when evidence_matches then 'fail_with_rejection'
   when fact_or_claim then 'fail_with_retry' when no_conflict then 'escalate_to_review' when time_and_region then 'fail_with_retry' when no_duplicate then 'escalate_to_review' else 'pass' end as outcome,
 concat_ws(',', case when industry_scope then 'industry_scope' end, case when entity_types then 'entity_types' end, case when relation_valid then 'relation_valid' end, case when traceable_source then 'traceable_source' end, case when original_evidence then 'original_evidence' end,
  case when evidence_matches then 'evidence_matches' end, case when fact_or_claim then 'fact_or_claim' end, case when no_conflict then 'no_conflict' end, case when time_and_region then 'time_and_region' end, case when no_duplicate then 'no_duplicate' end) as failed
 from (select c.id, c.industry_id not in (select industry_id from inds) as industry_scope, s.id is null or e.id is null as entity_types, not exists (select 1 from onto where relation_type = c.predicate and source_type = s.type and target_type = e.type) as relation_valid,
  not exists (select 1 from refs r join sources z on z.source_id = r.source_id where r.id = c.id and z.url is not null) as traceable_source, evidence_text = '' or evidence_kind is not null as original_evidence, not coalesce(contains(lower(evidence_text), lower(s.name)) and contains(lower(evidence_text), lower(e.name)), false) as evidence_matches,
  statement_class is null as fact_or_claim, exists (select 1 from act a where a.subject_id = c.subject_id and a.predicate = c.predicate and a.object_id <> c.object_id) as no_conflict, valid_from is null or region is null as time_and_region, exists (select 1 from act a where a.subject_id = c.subject_id and a.predicate = c.predicate and a.object_id = c.object_id) as no_duplicate
  from cands c left join ents s on s.id = c.subject_id left join ents e on e.id = c.object_id) x""",
    f"with {_WITH_CLAIMS}, {_CANDS}",
)
def policy_gate_failures(spark, d):
    refs = _view(spark, d, "refs")
    of = lambda name: _of(spark, d, f"{_WITH_CLAIMS}, {_CANDS}", name)
    got = rule_tables.gate_failures(of("cands"), of("ents"), of("onto"), of("inds"), refs, of("sources"), of("act"))
    return got.select("id", "outcome", F.array_join("failed", ",").alias("failed"))


_TASKS = """cites as (select id, concat('u', o % 50) as unit_id from claims where n = 1), units as (select distinct concat('u', doc_id % 47) as unit_id from documents),
 judged as (select id, case o % 5 when 0 then 'rejected' when 1 then 'review' when 2 then 'promoted' else 'pending' end as status, n = 2 as critical, case when o % 3 = 0 then ' ' when o % 3 = 1 then 'weak' end as rejection_reason, case when n <> 4 then 'g' end as failed_gate from claims),
 queue as (select id as target_id, case when id % 4 = 0 then 1 end as priority from judged where status = 'review' and id % 3 <> 0), audit as (select id as target_id, case when id % 7 = 0 then 'promoted' else status end as action from judged where id % 5 <> 0)"""


@query(
    """select 'citation_resolution' as "check", id::varchar as id from cites where unit_id not in (select unit_id from units) union all select 'linkage', id::varchar from claims where subject_id not in (select id from ents)
 union all select 'rejected_candidate_traceability', id::varchar from judged where status = 'rejected' and (coalesce(trim(rejection_reason), '') = '' or coalesce(trim(failed_gate), '') = '')
 union all select 'review_queue_completeness', id::varchar from judged where status = 'review' and critical and id not in (select target_id from queue where priority is not null)
 union all select 'audit_trail', id::varchar from judged j where status in ('promoted', 'rejected') and not exists (select 1 from audit where target_id = j.id and action = j.status)""",
    f"with {_WITH_CLAIMS}, {_CANDS}, {_TASKS}",
)
def task_check_failures(spark, d):
    of = lambda name: _of(spark, d, f"{_WITH_CLAIMS}, {_CANDS}, {_TASKS}", name)
    return rule_tables.task_failures(of("claims"), of("cites"), of("units"), of("ents"), of("judged"), of("queue"), of("audit"))


# --- snapshots, models, tenants ---


@query("""select 'lines' as "table", count(*) as rows, (select count(*) from lineitem where l_suppkey not in (select s_suppkey from supplier where s_suppkey % 10 <> 3)) as broken from lineitem union all select 'suppliers', count(*), 0 from supplier where s_suppkey % 10 <> 3""", "")
def snapshot_restored(spark, d):
    """A store of two tables is published, changed, backed up twice and restored; rows of the restored tables and references without a parent."""
    with Scratch(spark, "snapshots") as s:
        at, safe, back = (f"{s.path}/{x}" for x in ("store", "backup", "restored"))
        suppliers = table(spark, d, "supplier")
        snapshots.publish(spark, at, {"lines": table(spark, d, "lineitem"), "suppliers": suppliers})
        snapshots.copy(spark, at, safe)
        snapshots.publish(spark, at, {"suppliers": suppliers.where("s_suppkey % 10 <> 3")})
        snapshots.copy(spark, at, safe)
        snapshots.copy(spark, safe, back)
        tables = snapshots.read(spark, back)
        broken = snapshots.broken_keys(tables, [("lines", "l_suppkey", "suppliers", "s_suppkey")]).groupBy(F.col("child").alias("table")).agg(F.count("*").alias("broken"))
        counts = tables["lines"].select(F.lit("lines").alias("table")).unionByName(tables["suppliers"].select(F.lit("suppliers").alias("table"))).groupBy("table").agg(F.count("*").alias("rows"))
        return materialise(counts.join(broken, "table", "left").select("table", "rows", F.coalesce("broken", F.lit(0)).alias("broken")), "snapshot-report")


def _local_model():
    """A client without a network: the first word of a text as an entity; batches with a text on 'x' fail, as does such a text by itself."""

    def client(texts):
        if any(t.split()[0].lower().startswith("x") for t in texts):
            raise ConnectionError("refused")
        return [{"index": k, "payload": [{"text": t.split()[0], "type": "ORG" if len(t) % 3 else "place"}]} for k, t in reversed(list(enumerate(texts)))]

    return client


@query("""select p_partkey, case when bad or length(p_name) % 3 = 0 then 'all' else w end as name, case when bad or length(p_name) % 3 = 0 then 'fallback:rule:any' else 'ner:organization' end as generator, bad as failed
 from (select p_partkey, case when p_partkey % 50 = 0 then 'x' || p_name else p_name end as p_name, split_part(p_name, ' ', 1) as w, p_partkey % 50 = 0 or lower(p_name) like 'x%' as bad from part) x""", "")
def model_fallback(spark, d):
    parts = table(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 50 == 0, F.concat(F.lit("x"), "p_name")).otherwise(F.col("p_name")).alias("text"))
    results, _ = models.called(parts, "p_partkey", "text", _local_model, "local-1", batch=16, tries=2)
    found = models.recognised(results, "p_partkey").select("p_partkey", "name", "generator")
    rules = parts.select("p_partkey", F.lit("all").alias("name"), F.lit("rule:any").alias("generator"))
    got = models.with_fallback(results, found, rules, "p_partkey")
    return got.join(results.select("p_partkey", (~F.col("ok")).alias("failed")), "p_partkey")


@query("""select f.id, e.name from (select 'fact_' || l_orderkey || '_' || l_linenumber || '_' || l_partkey || '_' || l_suppkey as id, 'p' || l_partkey as subject_id, 't' || l_suppkey % 4 as tenant_id from lineitem) f
 left join (select 'p' || p_partkey as subject_id, 't' || p_partkey % 4 as tenant_id, p_name as name from part) e on e.subject_id = f.subject_id and e.tenant_id = 't1' where f.tenant_id = 't1'""", "")
def tenant_statements(spark, d):
    tables = {
        "assertion": table(spark, d, "lineitem").selectExpr("'fact_' || l_orderkey || '_' || l_linenumber || '_' || l_partkey || '_' || l_suppkey as id", "'p' || l_partkey as subject_id", "'t' || l_suppkey % 4 as tenant_id"),
        "product_record": table(spark, d, "part").selectExpr("'p' || p_partkey as subject_id", "'t' || p_partkey % 4 as tenant_id", "p_name as name"),
    }
    return tenants.Catalogue(tables, "t1").join("assertion", "product_record", ["subject_id"], "left").select("id", "name")


@query("""select 't' || n_regionkey as tenant_key, n_name as brand_key, case when n_regionkey < 2 then 'held_' || n_regionkey else 'tenant_' || substr(sha256('t' || n_regionkey), 1, 20) end as tenant_id,
 case when n_nationkey % 2 = 0 and n_regionkey < 2 then 'b' || n_nationkey else 'brand_' || substr(sha256((case when n_regionkey < 2 then 'held_' || n_regionkey else 'tenant_' || substr(sha256('t' || n_regionkey), 1, 20) end) || chr(31) || n_name || chr(31) || 'brand'), 1, 20) end as brand_id from nation""", "")
def tenant_contexts(spark, d):
    n = table(spark, d, "nation")
    held = n.where("n_regionkey < 2").selectExpr("'held_' || n_regionkey as id", "'t' || n_regionkey as tenant_key", "'x' as name", "'active' as status").distinct()
    brands = n.where("n_nationkey % 2 = 0 and n_regionkey < 2").selectExpr("'b' || n_nationkey as id", "'held_' || n_regionkey as tenant_id", "'brand' as entity_type", "n_name as canonical_name", "cast(null as string) as owner_brand", "'active' as status")
    spaces = brands.selectExpr("'w' || id as id", "tenant_id", "id as brand_entity_id", "'CN' as market", "'zh-CN' as language", "'active' as status")
    wanted = n.selectExpr("'t' || n_regionkey as tenant_key", "cast(null as string) as tenant_name", "n_name as brand_key", "'' as market", "cast(null as string) as language")
    return tenants.brand_context(held, brands, spaces, wanted)[3]


# --- the outbox as a stream ---

_CHANGES = """select event_id as id, case when event_id % 4 = 3 then 'relation' else 'entity' end as aggregate_type, case when event_id % 4 = 3 then concat('r', event_id % 97) else concat('u', user_id) end as aggregate_id, case when event_type = 'error' then 'delete' else 'upsert' end as event_type,
 {at} as created_at, case when event_id % 4 = 3 then concat('u', user_id) end as subject_id, case when event_id % 4 = 3 then concat('u', (user_id * 7 + event_id) % 150) end as object_id, event_type as name from {events}"""


def _refusing(event):
    """A target that refuses every seventh event twice."""
    if event["id"] % 7 == 0 and event["attempt"] < 3:
        raise ConnectionError("try again")


@query(
    """select 'vertex' as kind, aggregate_id as id, null as ends from shown where aggregate_type = 'entity' union all
 select 'edge', r.aggregate_id, r.subject_id || '>' || r.object_id from shown r join shown a on a.aggregate_type = 'entity' and a.aggregate_id = r.subject_id join shown b on b.aggregate_type = 'entity' and b.aggregate_id = r.object_id
 where r.aggregate_type = 'relation' and not exists (select 1 from e where e.aggregate_type = 'entity' and e.event_type = 'delete' and e.aggregate_id in (r.subject_id, r.object_id) and (e.created_at, e.id) > (r.created_at, r.id))""",
    "with e as (" + _CHANGES.format(at="epoch_us(ts)", events="events") + "), shown as (select * from (select *, row_number() over (partition by aggregate_type, aggregate_id order by created_at desc, id desc) as k from e) x where k = 1 and event_type = 'upsert')",
)
def projection_stream(spark, d):
    """Events in shuffled files, some twice, through the retrying stream; the graph is read off its log."""
    table(spark, d, "events").createOrReplaceTempView("kg_events")
    changes = spark.sql(_CHANGES.format(at="unix_micros(cast(ts as timestamp))", events="kg_events"))
    before = spark.conf.get(projector.RETRIES, None)
    spark.conf.set(projector.RETRIES, projector.ROCKS)
    try:
        with Scratch(spark, "projection") as s:
            twice = changes.unionByName(changes.where("id % 11 = 0"))
            twice.select(*projector.FIELDS).repartition(8, F.xxhash64("id")).write.parquet(f"{s.path}/in")
            projector.start(spark, f"{s.path}/in", f"{s.path}/log", f"{s.path}/checkpoint", _refusing, tries_now=3).awaitTermination()
            vertices, edges = projector.projection(projector.outcomes(spark, f"{s.path}/log"))
            v = vertices.select(F.lit("vertex").alias("kind"), "id", F.lit(None).cast("string").alias("ends"))
            return materialise(v.unionByName(edges.select(F.lit("edge").alias("kind"), "id", F.concat_ws(">", "source_id", "target_id").alias("ends"))), "projected")
    finally:
        spark.conf.set(projector.RETRIES, before) if before else spark.conf.unset(projector.RETRIES)


# --- scalar functions and edges of nodes ---


@query("""select p_partkey, p_name as display, 'relation::' || lower(regexp_replace(p_name, '[\\s，,、。;；：:]+', '', 'g')) || '::offers::' || lower(p_brand) as key, upper(regexp_replace(p_type, '[^0-9A-Za-z]+', '_', 'g')) as snake, array_to_string(list_transform(string_split_regex(p_type, '[^0-9A-Za-z]+'), lambda w: upper(w[1:1]) || w[2:]), '') as pascal,
 greatest(0, least(100, p_size * 4 - 40))::int as progress, case when p_size % 3 = 0 then 'L3' when p_size % 2 = 0 then 'L2' else 'L1' end as layer, 'a=1,b=' || case when p_size % 4 = 0 then 'x' || p_size else p_brand end as scope, case when p_size % 5 = 0 then -1 else p_size end::int as n, p_size % 2 = 0 or p_size % 7 = 0 as markdown, p_size % 3 = 1 as risky, p_size % 4 < 2 as taken_up from part""".replace("\\\\", "\\"), "")
def scalar_functions(spark, d):
    size = F.col("p_size")
    body = F.when(size % 5 == 0, F.lit("{broken")).otherwise(F.concat(F.lit('{"n": '), size.cast("string"), F.lit("}")))
    right = F.when(size % 4 == 0, F.create_map(F.lit("b"), F.concat(F.lit("x"), size.cast("string")))).otherwise(F.create_map().cast("map<string,string>"))
    scope = exprs.merged_scope(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.col("p_brand")), right)
    quotes = F.when(size % 3 == 1, F.array(F.lit("the best of all"))).otherwise(F.array().cast("array<string>"))
    return table(spark, d, "part").select(
        "p_partkey", exprs.display_name(F.concat("p_name", F.lit("。；"))).alias("display"), exprs.candidate_key(F.lit("relation"), F.col("p_name"), F.lit("offers"), F.col("p_brand"), F.lit(None)).alias("key"), exprs.upper_snake("p_type").alias("snake"), exprs.pascal("p_type").alias("pascal"),
        exprs.clamp_progress(size * 4 - 40).cast("int").alias("progress"), exprs.layer_of(F.when(size % 3 == 0, "b"), F.when(size % 2 == 0, "i")).alias("layer"), F.array_join(F.transform(F.array_sort(F.map_entries(scope)), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("scope"),
        exprs.json_or(body, "n int", F.struct(F.lit(-1).alias("n")))["n"].alias("n"), exprs.is_markdown(F.concat("p_name", F.when(size % 2 == 0, ".MD").otherwise(".txt")), F.when(size % 7 == 0, "text/markdown").otherwise("text/plain")).alias("markdown"),
        extract.high_risk(F.col("p_name"), quotes, ["best of"]).alias("risky"), reads.shown(F.when(size % 4 == 0, "queued").when(size % 4 == 1, "running").otherwise("done")).alias("taken_up"),
    )


@query("select f.id from facts f where f.subject_id in (select id from entities where layer = 'l3_brand') or f.object_id in (select id from entities where layer = 'l3_brand')", knowledge.FACTS)
def statements_touching(spark, d):
    return graph.touching(knowledge.facts(spark, d), entities(spark, d).where("layer = 'l3_brand'")).select("id")
