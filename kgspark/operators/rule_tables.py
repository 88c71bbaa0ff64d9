"""Rule tables over statements, candidates and tasks: rules as data, all of them in one pass, one row a failure.

What the rules ask is first derived from references, sources, times and the
rows of the same fact; then every rule is a bit of one mask, and the mask is
taken apart once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from kgspark.operators.promotion import POLICY_GATES
from kgspark.operators.rules import REJECTED_EVIDENCE, authority
from kgspark.session import Scratch, materialise

# fixed values: words of self-praise and of absolute statements, and what official material can't prove by itself
PRAISE = "行业领先|最安全|市场第一|leader|leading|safest"
ABSOLUTE = "行业第一|最佳|绝对安全|100%|best|absolutely safe"
NOT_FOR_OFFICIAL = ("market_share", "comparison", "third_party_evaluation")
KINDS = ("fact", "claim", "observation", "inference")
# fixed values: search observations need so many views over so many days
VIEWS, VIEW_DAYS = 3, 7
OFFICIAL = ("official", "company_disclosure")
#: Types of sources that the rules name: a row's are kept as bits, as sets would be sorted.
TYPES = (*OFFICIAL, "government_regulatory", "standards_body", "academic", "third_party_review", "community", "search_observation")

#: Rule, group, priority; the predicates of failing are in quality_predicates(), by rule.
QUALITY_RULES = (
    ("rule_fact_001", "fact_claim", "critical"), ("rule_fact_002", "fact_claim", "critical"), ("rule_fact_003", "fact_claim", "critical"), ("rule_fact_004", "fact_claim", "high"),
    ("rule_source_001", "source_usage", "high"), ("rule_source_002", "source_usage", "high"), ("rule_source_003", "source_usage", "high"), ("rule_source_004", "source_usage", "medium"), ("rule_source_005", "source_usage", "medium"), ("rule_source_006", "source_usage", "high"),
    ("rule_evidence_001", "evidence_chain", "critical"), ("rule_evidence_002", "evidence_chain", "critical"), ("rule_evidence_003", "evidence_chain", "high"), ("rule_evidence_004", "evidence_chain", "medium"),
    ("rule_quality_001", "quality", "high"), ("rule_quality_002", "quality", "medium"), ("rule_quality_003", "quality", "high"), ("rule_quality_004", "quality", "medium"), ("rule_quality_005", "quality", "medium"),
)


def _bit(kind: Column) -> Column:
    """The bit of a source's type: its place in TYPES, the next one for a type that is not there, none for null."""
    known = reduce(lambda w, k: w.when(kind == TYPES[k], F.lit(1 << k)), range(1, len(TYPES)), F.when(kind == TYPES[0], F.lit(1)))
    return known.when(kind.isNotNull(), F.lit(1 << len(TYPES))).otherwise(F.lit(0)).cast("bigint")


def with_sources(rows: DataFrame, refs: DataFrame, sources: DataFrame, key: str = "id") -> DataFrame:
    """rows with what their references come to: n_sources, n_traceable (with a url), n_own, n_high, types (a bit for each of TYPES, one for all others), views and view_days of observations.

    refs: key, source_id (a reference given twice counts once, an unknown source not at all); sources: source_id, source_type, brand_id, url, observed_day.
    """
    s = sources.select("source_id", "source_type", F.col("brand_id").alias("kg_brand"), "url", "observed_day")
    met = refs.select(key, "source_id").distinct().join(s, "source_id").join(rows.select(key, F.col("brand_id").alias("kg_own")), key)
    high = F.coalesce(authority(F.col("source_type")) == "high", F.lit(False))
    got = met.groupBy(key).agg(
        F.count("*").alias("n_sources"), F.count_if(F.col("url").isNotNull()).alias("n_traceable"), F.count_if(F.col("source_type").isin(*OFFICIAL) & (F.col("kg_brand") == F.col("kg_own"))).alias("n_own"), F.count_if(high).alias("n_high"),
        F.bit_or(_bit(F.col("source_type"))).alias("types"), F.count_distinct("observed_day").alias("views"), (F.max("observed_day") - F.min("observed_day")).alias("view_days"),
    )
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("n_sources", "n_traceable", "n_own", "n_high", "types", "views", "view_days")}
    return rows.join(got, key, "left").withColumns(zero)


def with_peers(rows: DataFrame, s: Scratch) -> DataFrame:
    """rows (subject_id, predicate, object_value, n_high) with fact_high (most high sources of a fact on the subject and predicate), fact_values (its distinct values) and fact_same (rows of the same value)."""
    same = rows.groupBy("subject_id", "predicate", "object_value").agg(F.count("*").alias("kg_n"), F.max("n_high").alias("kg_high"))
    facts = same.groupBy("subject_id", "predicate").agg(F.max("kg_high").alias("fact_high"), F.count_if(F.col("object_value").isNotNull()).alias("fact_values"))
    counted = same.select("subject_id", "predicate", "object_value", F.col("kg_n").alias("fact_same")).join(facts, ["subject_id", "predicate"])
    counted = s.write(counted, "facts")
    on = reduce(lambda a, b: a & b, (F.col(f"r.{c}").eqNullSafe(F.col(f"c.{c}")) for c in ("subject_id", "predicate", "object_value")))
    return rows.alias("r").join(counted.alias("c"), on, "left").select("r.*", *[F.coalesce(f"c.{x}", F.lit(0)).alias(x) for x in ("fact_high", "fact_values", "fact_same")])


def quality_predicates(as_of: Column) -> dict[str, Column]:
    """When a row of with_sources() and with_peers() fails each rule."""
    c = F.col
    kind, types = c("statement_type"), c("types")
    fact, stated = kind == "fact", kind.isin("fact", "claim")
    text = F.lower(F.coalesce("statement_text", F.lit("")))
    number = text.rlike("[0-9]")
    bits = lambda t: F.lit(sum(1 << TYPES.index(x) for x in t)).cast("bigint")
    only = lambda *t: (c("n_sources") > 0) & (types.bitwiseOR(bits(t)) == bits(t))
    never = lambda *t: types.bitwiseAND(bits(t)) == 0
    gone = lambda *names: reduce(lambda a, b: a | b, (c(n).isNull() for n in names))
    return {
        "rule_fact_001": fact & (c("n_sources") == 0), "rule_fact_002": fact & number & gone("value", "unit", "period", "region"),
        "rule_fact_003": fact & text.rlike(PRAISE) & (c("n_sources") > 0) & (c("n_own") == c("n_sources")),
        "rule_fact_004": stated & ((c("period").isNotNull() & c("valid_to").isNull()) | ((c("valid_to") < as_of) & (c("status") == "active"))),
        "rule_source_001": fact & c("topic").isin(*NOT_FOR_OFFICIAL) & only(*OFFICIAL), "rule_source_002": fact & (c("topic") == "compliance") & never("government_regulatory", "standards_body"),
        "rule_source_003": fact & (c("topic") == "research") & never("academic"), "rule_source_004": fact & (c("topic") == "market_share") & only("third_party_review") & (c("n_sources") < 2),
        "rule_source_005": fact & only("community"), "rule_source_006": (c("status") == "active") & only("search_observation") & ((c("views") < VIEWS) | (c("view_days") < VIEW_DAYS)),
        "rule_evidence_001": kind.isNull() | ~kind.isin(*KINDS), "rule_evidence_002": stated & (c("n_traceable") == 0), "rule_evidence_003": kind.isin("claim", "fact") & text.rlike(ABSOLUTE) & (c("n_high") == 0),
        "rule_evidence_004": kind.isin("fact", "claim", "observation") & (F.coalesce("confidence", F.lit(0.0)) < 0.5) & (c("status") != "pending_verification"),
        "rule_quality_001": fact & (c("n_sources") > 0) & (c("n_high") == 0) & (c("fact_high") > 0), "rule_quality_002": fact & (c("fact_same") > 1), "rule_quality_003": stated & (c("fact_values") > 1) & ~F.coalesce("conflict_marked", F.lit(False)),
        "rule_quality_004": stated & (gone("topic", "permission") | (c("brand_id").isNull() & c("industry_id").isNull())), "rule_quality_005": fact & (F.length("statement_text") > 20) & c("summary").isNull(),
    }


def failures(rows: DataFrame, key: str, predicates: dict[str, Column], named: str = "rule") -> DataFrame:
    """key, rule for each predicate that holds: one mask a row, taken apart once. A null is no failure. At most 63 rules."""
    names = list(predicates)
    mask = reduce(lambda a, b: a.bitwiseOR(b), (F.when(F.coalesce(predicates[n], F.lit(False)), F.lit(1 << k)).otherwise(F.lit(0)).cast("bigint") for k, n in enumerate(names)))
    bits = F.filter(F.sequence(F.lit(0), F.lit(len(names) - 1)), lambda k: F.getbit("kg_mask", k) == 1)
    table = F.array(*[F.lit(n) for n in names])
    return rows.select(key, mask.alias("kg_mask")).where("kg_mask <> 0").select(key, F.explode(bits).alias("k")).select(key, F.get(table, F.col("k")).alias(named))


def quality_failures(statements: DataFrame, refs: DataFrame, sources: DataFrame, as_of: Column) -> DataFrame:
    """id, rule, category, priority for each of the 19 quality rules that a statement fails.

    statements: id, statement_type, subject_id, predicate, object_value, statement_text, value, unit, period, region, topic, valid_to, status, confidence, conflict_marked, brand_id, industry_id, permission, summary.
    """
    with Scratch(statements.sparkSession, "rules") as s:
        rows = s.write(with_sources(statements, refs, sources), "sourced")
        # what the facts come to is small beside the rows and is written, so that the planner sees its size and sends it to the rows
        got = materialise(failures(with_peers(rows, s), "id", quality_predicates(as_of)), "failures")
    of = lambda i: F.element_at(F.create_map(*[F.lit(x) for r in QUALITY_RULES for x in (r[0], r[i])]), F.col("rule"))
    return got.withColumns({"category": of(1), "priority": of(2)})


def gate_failures(cands: DataFrame, entities: DataFrame, ontology: DataFrame, industries: DataFrame, refs: DataFrame, sources: DataFrame, active: DataFrame) -> DataFrame:
    """id, outcome, failed (gates in order) of candidates under the policy's ten gates, each computed from the tables.

    cands: id, industry_id, subject_id, predicate, object_id, brand_id, statement_class, evidence_text, evidence_kind, valid_from, region; entities: id, type, name; ontology: relation_type,
    source_type, target_type; industries: industry_id; refs and sources as in with_sources(); active: subject_id, predicate, object_id. The outcome is the first failing gate's, else pass.
    """
    side = lambda x: entities.select(F.col("id").alias(f"{x}_id"), F.col("type").alias(f"{x}_type"), F.lower("name").alias(f"{x}_name")).dropDuplicates([f"{x}_id"])
    rows = with_sources(cands, refs, sources).join(side("subject"), "subject_id", "left").join(side("object"), "object_id", "left")
    flag = lambda df, cols, name: df.select(*cols).distinct().withColumn(name, F.lit(True))
    rows = rows.join(flag(industries, ["industry_id"], "kg_industry"), "industry_id", "left")
    rules = ontology.select(F.col("relation_type").alias("predicate"), F.col("source_type").alias("subject_type"), F.col("target_type").alias("object_type"))
    rows = rows.join(flag(rules, ["predicate", "subject_type", "object_type"], "kg_fits"), ["predicate", "subject_type", "object_type"], "left")
    held = active.groupBy("subject_id", "predicate").agg(F.min("object_id").alias("kg_lo"), F.max("object_id").alias("kg_hi"))
    rows = rows.join(held, ["subject_id", "predicate"], "left").join(flag(active, ["subject_id", "predicate", "object_id"], "kg_same"), ["subject_id", "predicate", "object_id"], "left")
    c, text = F.col, F.lower(F.coalesce("evidence_text", F.lit("")))
    bad = {
        "industry_scope": c("kg_industry").isNull(), "entity_types": c("subject_type").isNull() | c("object_type").isNull(), "relation_valid": c("kg_fits").isNull(), "traceable_source": c("n_traceable") == 0,
        "original_evidence": (F.trim(text) == "") | F.coalesce(c("evidence_kind").isin(*REJECTED_EVIDENCE), F.lit(False)),
        "evidence_matches": ~F.coalesce(F.contains(text, c("subject_name")) & F.contains(text, c("object_name")), F.lit(False)), "fact_or_claim": ~F.coalesce(c("statement_class").isin(*KINDS), F.lit(False)),
        "no_conflict": (c("kg_lo") != c("object_id")) | (c("kg_hi") != c("object_id")), "time_and_region": c("valid_from").isNull() | c("region").isNull(), "no_duplicate": c("kg_same").isNotNull(),
    }
    order = [g for g, _ in POLICY_GATES]
    failed = F.array_compact(F.array(*[F.when(F.coalesce(bad[g], F.lit(False)), g) for g in order]))
    outcome = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in POLICY_GATES for x in pair]), F.get(failed, F.lit(0))), F.lit("pass"))
    return rows.select("id", outcome.alias("outcome"), failed.alias("failed"))


def task_failures(statements: DataFrame, citations: DataFrame, units: DataFrame, entities: DataFrame, candidates: DataFrame, queue: DataFrame, audit: DataFrame) -> DataFrame:
    """check, id of what the tasks' quality checks find.

    citation_resolution: citations (id, unit_id) of units that are not there; linkage: statements (id, subject_id) whose subject is not there; rejected_candidate_traceability: rejected
    candidates (id, status, critical, rejection_reason, failed_gate) without a reason or gate; review_queue_completeness: critical candidates in review that the queue (target_id, priority) lacks or holds without priority;
    audit_trail: promoted or rejected candidates without an audit row (target_id, action of the candidate's status).
    """
    row = lambda name, df: df.select(F.lit(name).alias("check"), F.col("id").cast("string").alias("id"))
    blank = lambda x: F.trim(F.coalesce(x, F.lit(""))) == ""
    lost = citations.join(units.select(F.col("unit_id")).distinct(), "unit_id", "left_anti")
    loose = statements.join(entities.select(F.col("id").alias("subject_id")).distinct(), "subject_id", "left_anti")
    silent = candidates.where((F.col("status") == "rejected") & (blank("rejection_reason") | blank("failed_gate")))
    waiting = candidates.where((F.col("status") == "review") & F.coalesce("critical", F.lit(False))).join(queue.where("priority is not null").select(F.col("target_id").alias("id")).distinct(), "id", "left_anti")
    unseen = candidates.where(F.col("status").isin("promoted", "rejected")).join(audit.select(F.col("target_id").alias("id"), F.col("action").alias("status")).distinct(), ["id", "status"], "left_anti")
    found = (("citation_resolution", lost), ("linkage", loose), ("rejected_candidate_traceability", silent), ("review_queue_completeness", waiting), ("audit_trail", unseen))
    return reduce(DataFrame.unionByName, (row(n, df) for n, df in found))
