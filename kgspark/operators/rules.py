"""Governance rules as predicates and rates: what may be shown, what an assertion needs, source classes, quality metrics, brand metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

#: Access levels from open to closed.
ACCESS = ("public", "internal", "confidential", "restricted")
#: Evidence that is never taken.
REJECTED_EVIDENCE = ("search_snippets", "blocked_pages", "community_content", "llm_generated_without_source", "expired_content", "machine_translated_content", "cached_or_archived_without_original", "personal_communication")
#: Source types by authority.
AUTHORITY = {
    "high": ("official", "government_regulatory", "academic", "industry_report", "standards_body", "industry_association", "company_disclosure"),
    "medium": ("third_party_review", "media", "brokerage_research"),
    "low": ("community", "search_observation", "aggregator"),
}
#: Kinds of assertions, their statement class, and whether they may be put out.
ASSERTION_KINDS = (
    ("identity_fact", "fact", "true"), ("product_spec", "fact", "per_document_permission"), ("self_claim", "claim", "subject_to_claim_review"), ("attributed_claim", "claim", "upon_authorization"),
    ("third_party_fact", "fact", "per_source_license"), ("internal_fact", "fact", "false_by_default"), ("draft_claim", "claim", "false"), ("inference", "inference", "not_as_stable_fact"),
)
#: Fields of a context package.
PACKAGE = ("query", "scope", "entities", "relations", "assertions", "evidence", "conflicts", "missing_information")


def looked_up(table: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def rank_of(level: Column) -> Column:
    """Place of an access level; an unknown one is closed to all."""
    place = F.array_position(F.array(*[F.lit(a) for a in ACCESS]), level)
    return F.when(F.coalesce(place, F.lit(0)) == 0, F.lit(len(ACCESS) + 1)).otherwise(place)


def may_use(task: str, channel: str, level: str) -> Column:
    """Hard filter over allowed_task_types, allowed_output_channels, publication_status, access_level: prohibited rows go to no public output."""
    public = channel in ("customer_report", "public_content")
    ok = F.array_contains("allowed_task_types", task) & F.array_contains("allowed_output_channels", channel) & (rank_of(F.col("access_level")) <= ACCESS.index(level) + 1)
    return F.coalesce(ok & (F.col("publication_status") != "prohibited") if public else ok, F.lit(False))


def in_scope(brand: str) -> Column:
    """Shared rows, and the target brand's own."""
    return F.coalesce((F.col("scope") == "shared") | ((F.col("scope") == "brand_specific") & (F.col("brand_id") == brand)), F.lit(False))


def evidence_allowed(kind: Column) -> Column:
    return ~F.coalesce(kind.isin(*REJECTED_EVIDENCE), F.lit(False))


def for_tenant(rows: DataFrame, tenant: str, column: str = "tenant_id") -> DataFrame:
    """Row-level security: rows of one tenant; rows without one belong to none."""
    return rows.where(F.col(column) == tenant)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))


def with_source_rules(rows: DataFrame, url: str, blocked: DataFrame, trusted: DataFrame) -> DataFrame:
    """rows with host, is_blocked, is_trusted: the host or one of its parent domains is in the list (column domain)."""
    rows = rows.withColumn("host", host_of(F.col(url)))
    labels = F.split("host", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    hosts = rows.select("host").distinct().select("host", F.explode(parents).alias("domain"))
    hit = lambda listed, name: hosts.join(listed.select("domain").distinct(), "domain", "left_semi").select("host").distinct().withColumn(name, F.lit(True))
    out = rows.join(hit(blocked, "is_blocked"), "host", "left").join(hit(trusted, "is_trusted"), "host", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("is_blocked", "is_trusted")})


def authority(source_type: Column) -> Column:
    return looked_up({t: level for level, ts in AUTHORITY.items() for t in ts}, source_type)


def statement_class(kind: Column) -> Column:
    return looked_up({k: c for k, c, _ in ASSERTION_KINDS}, kind)


def public_output(kind: Column) -> Column:
    return looked_up({k: p for k, _, p in ASSERTION_KINDS}, kind)


def assertion_errors() -> Column:
    """What an assertion (statement_class, source_refs, valid_from, valid_to, supporting_refs) lacks, as an array."""
    none = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    kind = F.coalesce("statement_class", F.lit(""))
    return F.array_compact(F.array(
        F.when(kind == "", "statement_class missing"), F.when(kind.isin("fact", "claim") & none("source_refs"), "source_refs missing"),
        F.when((kind == "observation") & F.col("valid_from").isNull() & F.col("valid_to").isNull(), "validity missing"), F.when((kind == "inference") & none("supporting_refs"), "supporting_assertion_refs missing"),
    ))


def missing_fields(present: Column, required: tuple[str, ...] = PACKAGE) -> Column:
    """Required names that an array of present ones lacks, sorted: of a context package, or of a metric's context."""
    return F.array_sort(F.array_except(F.array(*[F.lit(r) for r in required]), F.coalesce(present, F.array().cast("array<string>"))))


def proposal_errors(types: list[str], states: list[str]) -> Column:
    """What is wrong with a change proposal (proposal_id, proposal_type, status, evidence array, rollback_plan); an absent status counts as draft."""
    status = F.coalesce("status", F.lit("draft"))
    blank = lambda c: F.coalesce(F.col(c) == "", F.lit(True))
    return F.array_compact(F.array(
        F.when(blank("proposal_id"), "proposal_id is required"), F.when(~F.coalesce(F.col("proposal_type").isin(types), F.lit(False)), "proposal_type"), F.when(~status.isin(states), "status"),
        F.when(F.coalesce(F.size("evidence"), F.lit(0)) <= 0, "evidence is required"), F.when((status == "published") & blank("rollback_plan"), "published proposals require rollback_plan"),
    ))


def rates(rows: DataFrame, by: list[str], **tests: Column) -> DataFrame:
    """Share of rows that pass each test, to four places; a null counts as not passed."""
    one = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 4)
    out = [one(c).alias(n) for n, c in tests.items()]
    return rows.groupBy(*by).agg(*out) if by else rows.agg(*out)


def governance_metrics(rows: DataFrame, by: list[str]) -> DataFrame:
    """The eight quality metrics over rows of flags: resolved, relation_valid, has_evidence, conflict_found, is_duplicate, stale_found, promoted, grounded."""
    return rates(
        rows, by, entity_resolution_accuracy=F.col("resolved"), relation_validity_rate=F.col("relation_valid"), evidence_coverage=F.col("has_evidence"), conflict_detection_rate=F.col("conflict_found"),
        duplicate_rate=F.col("is_duplicate"), stale_detection_rate=F.col("stale_found"), promotion_acceptance_rate=F.col("promoted"), retrieval_grounding_rate=F.col("grounded"),
    )


def coverage(have: DataFrame, want: DataFrame, by: str, item: str) -> DataFrame:
    """Per group, the share of wanted items (item) that it has: product coverage, capability completeness."""
    n = want.select(item).distinct().agg(F.count("*").alias("wanted"))
    got = have.select(by, item).distinct().join(want.select(item).distinct(), item, "left_semi").groupBy(by).agg(F.count("*").alias("held"))
    every = have.select(by).distinct().join(got, by, "left").withColumn("held", F.coalesce("held", F.lit(0)))
    return every.crossJoin(n).select(by, "held", "wanted", F.when(F.col("wanted") > 0, F.round(F.col("held") / F.col("wanted"), 4)).alias("coverage"))


def fact_ready(observations: DataFrame, key: list[str], value: str, day: str, high: str, least: int = 3, days: int = 7) -> DataFrame:
    """Observations of one key and value that make a fact: enough of them, over enough days, one at least of high authority."""
    g = observations.groupBy(*key, value).agg(F.count("*").alias("n"), F.datediff(F.max(day), F.min(day)).alias("days"), F.count_if(high).alias("high"))
    return g.withColumn("is_fact", (F.col("n") >= least) & (F.col("days") >= days) & (F.col("high") >= 1))


def out_of_enum(rows: DataFrame, key: str, allowed: dict[str, list[str]]) -> DataFrame:
    """key, column, value of rows whose non-null value isn't among a column's allowed ones."""
    parts = [rows.where(F.col(c).isNotNull() & ~F.col(c).isin(v)).select(F.col(key).cast("string").alias(key), F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c, v in allowed.items()]
    return reduce(DataFrame.unionByName, parts)


def without_link(entities: DataFrame, relations: DataFrame, kind: str, relation: str, end: str = "source_id") -> DataFrame:
    """Entities of a type that lack a required relation at one end."""
    linked = relations.where(F.col("relation_type") == relation).select(F.col(end).alias("id")).distinct()
    return entities.where(F.col("type") == kind).join(linked, "id", "left_anti")


def too_many(relations: DataFrame, relation: str, one: str) -> DataFrame:
    """Ends (source_id or target_id) that a relation links more than once though it may once: end, n."""
    return relations.where(F.col("relation_type") == relation).groupBy(F.col(one).alias("end")).agg(F.count("*").alias("n")).where("n > 1")


def dimensions(codes: DataFrame, groups: list[str]) -> DataFrame:
    """group, codes (sorted), of rows group, code; groups without codes have none."""
    spark = codes.sparkSession
    every = spark.createDataFrame([(g,) for g in groups], "group string")
    got = codes.groupBy("group").agg(F.sort_array(F.collect_set("code")).alias("codes"))
    return every.join(F.broadcast(got) if len(groups) < 1000 else got, "group", "left").withColumn("codes", F.coalesce("codes", F.array().cast("array<string>")))
