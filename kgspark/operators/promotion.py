"""Promotion of candidates from their references and the ontology: gates, fusion of groups, writers, payload checks, policy outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from kgspark.functions.exprs import normalize_name
from kgspark.operators.hot import join_one

#: Statuses of evidence that supports a candidate.
ACCESS_OK, SUPPORT_OK = ("ok", "crawled"), ("supports", "verified")
KINDS = ("relation", "statement", "metric", "event")
#: The policy's ten gates in order, with the outcome of a failure.
POLICY_GATES = (
    ("industry_scope", "fail_with_rejection"), ("entity_types", "fail_with_rejection"), ("relation_valid", "fail_with_rejection"), ("traceable_source", "fail_with_retry"),
    ("original_evidence", "fail_with_retry"), ("evidence_matches", "fail_with_rejection"), ("fact_or_claim", "fail_with_retry"), ("no_conflict", "escalate_to_review"),
    ("time_and_region", "fail_with_retry"), ("no_duplicate", "escalate_to_review"),
)


def ontology_gate(rows: DataFrame, entities: DataFrame, types: list[str], rules: DataFrame) -> DataFrame:
    """Adds gate_ontology. rules: relation_type, source_type, target_type.

    Ends of an unknown entity pass the test of types; known ones must have a type of the list. A relation with a predicate and both
    ends needs a predicate of the rules, and types that some rule of the predicate allows (so an unknown entity fails there).
    """
    kinds = entities.select("id", "type")
    fits = rules.selectExpr("relation_type as kg_rule", "source_type as kg_subject", "target_type as kg_object").distinct().withColumn("kg_fits", F.lit(True))
    typed = lambda c: F.col(c).isNull() | F.col(c).isin(types)
    checked = (F.col("knowledge_type") == "relation") & F.col("predicate").isNotNull() & F.col("subject_id").isNotNull() & F.col("object_id").isNotNull()
    # objects that many rows name are sent to the rows; what is left of a row's object goes on to the subjects, not its texts
    got = join_one(rows, kinds.select(F.col("id").alias("object_id"), F.col("type").alias("kg_type")), ["object_id"])
    got = got.withColumns({"kg_rule": F.when(checked, F.col("predicate")), "kg_object": F.when(checked, F.col("kg_type")), "kg_typed": typed("kg_type"), "kg_checked": checked}).drop("kg_type")
    got = got.join(kinds.select(F.col("id").alias("subject_id"), F.col("type").alias("kg_subject")), "subject_id", "left").join(F.broadcast(fits), ["kg_rule", "kg_subject", "kg_object"], "left")
    ok = F.col("kg_typed") & typed("kg_subject") & (~F.col("kg_checked") | F.col("kg_fits").isNotNull())
    return got.withColumn("gate_ontology", F.coalesce(ok, F.lit(False))).select(*rows.columns, "gate_ontology")


def evidence_gate(refs: Column) -> Column:
    """Whether there are references and each has an access and a support status that count."""
    good = F.forall(refs, lambda r: F.coalesce(r["access_status"].isin(*ACCESS_OK) & r["support_status"].isin(*SUPPORT_OK), F.lit(False)))
    return F.coalesce((F.size(refs) > 0) & good, F.lit(False))


def conflict_gate(rows: DataFrame, active: DataFrame) -> DataFrame:
    """Adds gate_conflict: false for a relation with both ends and a predicate where an active row has the same subject and predicate and another object. Rows of other kinds pass."""
    known = active.select("subject_id", "predicate", "object_id").distinct().groupBy("subject_id", "predicate").agg(F.min("object_id").alias("kg_lo"), F.max("object_id").alias("kg_hi"))
    got = rows.join(known, ["subject_id", "predicate"], "left")
    other = (F.col("knowledge_type") == "relation") & ((F.col("kg_lo") != F.col("object_id")) | (F.col("kg_hi") != F.col("object_id")))
    return got.withColumn("gate_conflict", ~F.coalesce(other, F.lit(False))).select(*rows.columns, "gate_conflict")


def anchored(cands: DataFrame, gate_entities: DataFrame) -> DataFrame:
    """Candidates whose subject (type, normalised name) is a gate entity, with its id; an absent type counts as organization. Others are dropped."""
    g = gate_entities.select(F.col("entity_type").alias("kg_type"), F.col("normalized_name").alias("kg_name"), "entity_id")
    kind = F.coalesce("subject_type", F.lit("organization"))
    return cands.join(g, (kind == F.col("kg_type")) & (normalize_name("subject_name") == F.col("kg_name"))).drop("kg_type", "kg_name")


def fused_groups(cands: DataFrame) -> DataFrame:
    """Groups of anchored candidates (candidate_id, candidate_type, entity_id, predicate, label, object_name, confidence, document_id, published_at).

    Relations group by subject and predicate, others by subject and label. A group of several members with several objects is a conflict:
    its members stay single. Else it is one row: the first member's object, greatest confidence and date, ordered documents and candidates.
    A relation without predicate is not written: it comes with status invalid.
    """
    label = F.when(F.col("candidate_type") == "relation", F.col("predicate")).otherwise(F.col("label"))
    rows = cands.withColumn("group_label", F.coalesce(label, F.lit("")))
    by = ["candidate_type", "entity_id", "group_label"]
    # several objects: the least and the greatest differ. One shuffle by the group serves this and the sums
    w, known = Window.partitionBy(*by), F.coalesce("object_name", F.lit("∅"))
    rows = rows.withColumn("conflict", F.min(known).over(w) != F.max(known).over(w))
    rows = rows.withColumn("unit", F.when(F.col("conflict"), F.col("candidate_id")).otherwise(F.lit("")))
    invalid = (F.col("candidate_type") == "relation") & (F.col("group_label") == "")
    out = rows.groupBy(*by, "unit").agg(
        F.min_by("object_name", "candidate_id").alias("object_name"), F.max("confidence").alias("confidence"), F.max("published_at").alias("published_at"), F.count("*").alias("members"),
        F.array_sort(F.collect_set("candidate_id")).alias("source_candidate_ids"), F.array_sort(F.collect_set("document_id")).alias("source_document_ids"), F.max("conflict").alias("conflict"),
    )
    return out.withColumn("status", F.when(invalid, "invalid").when(F.col("conflict"), "conflicted").otherwise("fused")).drop("unit")


def fusion_counts(groups: DataFrame) -> DataFrame:
    """fused, conflicted, emitted, conflict_groups of fused_groups()."""
    valid = groups.where("status <> 'invalid'")
    return valid.agg(
        F.coalesce(F.sum(F.when(~F.col("conflict"), F.col("members") - 1)), F.lit(0)).cast("bigint").alias("fused"), F.count_if("conflict").alias("conflicted"), F.count("*").alias("emitted"),
        F.count_distinct(F.when(F.col("conflict"), F.concat_ws("\x1f", "candidate_type", "entity_id", "group_label"))).alias("conflict_groups"),
    )


def promoted(rows: DataFrame) -> dict[str, DataFrame]:
    """Rows that passed, by the table they go to: relations need both ends and a predicate, metrics a value, statements and events a text."""
    of = lambda kind: rows.where((F.col("disposition") == "promote") & (F.col("knowledge_type") == kind))
    return {
        "relation": of("relation").where("subject_id is not null and object_id is not null and predicate is not null").select("id", "subject_id", "predicate", "object_id", "confidence"),
        "statement": of("statement").select("id", "subject_id", F.col("value").alias("statement_text"), "confidence"),
        "metric": of("metric").where("value is not null").select("id", "subject_id", F.col("predicate").alias("metric_type"), F.col("value").alias("metric_value"), "confidence"),
        "event": of("event").select("id", "subject_id", F.col("value").alias("event_name"), "confidence"),
    }


def payload_errors(entities: DataFrame, relations: DataFrame, statements: DataFrame, types: list[str], rules: DataFrame, classes: list[str]) -> DataFrame:
    """payload_id, kind, id, error of extracted payloads: entities (payload_id, id, type), relations (payload_id, subject, relation, object, confidence), statements (payload_id, id, statement_class)."""
    bad = entities.where(~F.coalesce(F.col("type").isin(types), F.lit(False))).select("payload_id", F.lit("entity").alias("kind"), "id", F.lit("unknown entity type").alias("error"))
    # a payload is one answer, so its entities are few: they meet its relations in one join
    e = entities.where(F.col("id").isNotNull()).groupBy("payload_id").agg(F.sort_array(F.collect_set(F.struct(F.col("id").alias("kg_id"), F.col("type").alias("kg_t")))).alias("kg_all"))
    ends = relations.join(e, "payload_id", "left")
    found_at = lambda c: F.get(F.filter("kg_all", lambda x: x["kg_id"] == F.col(c)), F.lit(0))
    for c in ("subject", "object"):
        one = found_at(c)
        ends = ends.withColumns({f"{c}_type": one["kg_t"], f"{c}_found": F.when(one.isNotNull(), True)})
    ends = ends.drop("kg_all")
    known = rules.select(F.col("relation_type").alias("relation")).distinct().withColumn("kg_known", F.lit(True))
    fits = rules.selectExpr("relation_type as relation", "source_type as subject_type", "target_type as object_type").distinct().withColumn("kg_fits", F.lit(True))
    ends = ends.join(F.broadcast(known), "relation", "left").join(F.broadcast(fits), ["relation", "subject_type", "object_type"], "left")
    missing = lambda c: F.when(F.col(f"{c}_found").isNull(), f"{c} not found")
    both = F.col("subject_found").isNotNull() & F.col("object_found").isNotNull()
    found = F.array_compact(F.array(
        missing("subject"), missing("object"), F.when(both & F.col("kg_fits").isNull(), "domain/range invalid"),
        F.when((F.col("confidence") < 0) | (F.col("confidence") > 1), "confidence out of [0,1]"),
    ))
    errors = F.when(F.col("kg_known").isNull(), F.array(F.lit("unknown relation type"))).otherwise(found)
    rel = ends.select("payload_id", F.lit("relation").alias("kind"), F.concat_ws("-", "subject", "relation", "object").alias("id"), F.explode(errors).alias("error"))
    wrong = statements.where(F.col("statement_class").isNotNull() & (F.col("statement_class") != "") & ~F.col("statement_class").isin(classes))
    return bad.unionByName(rel).unionByName(wrong.select("payload_id", F.lit("statement").alias("kind"), "id", F.lit("invalid statement_class").alias("error")))


def policy_outcome(passed: dict[str, Column]) -> Column:
    """Outcome of the ten gates in order: the first failing gate's, else pass. A gate without a column, or with null, fails."""
    out = F.lit("pass")
    for name, outcome in reversed(POLICY_GATES):
        out = F.when(~F.coalesce(passed.get(name, F.lit(False)), F.lit(False)), F.lit(outcome)).otherwise(out)
    return out


def capped_units(units: DataFrame, most: int = 200) -> DataFrame:
    """The first units of each document by unit_id, the batch extraction's own limit."""
    w = Window.partitionBy("doc_id").orderBy("unit_id")
    return units.withColumn("kg_k", F.row_number().over(w)).where(F.col("kg_k") <= most).drop("kg_k")


def emitted(payload_rows: DataFrame, extractable: list[str], default: dict[str, float]) -> DataFrame:
    """Rows of validated payloads (kind, type, confidence, ok) as candidates: extractable entity types only, the kind's confidence where none is given.

    ok: whether the unit's model call gave a payload; where it didn't, the generator is marked as a fall-back.
    """
    base = F.create_map(*[x for k, v in default.items() for x in (F.lit(k), F.lit(v))])
    rows = payload_rows.where((F.col("kind") != "entity") | F.col("type").isin(extractable))
    generator = F.when(F.coalesce("ok", F.lit(False)), F.lit("llm:structured")).otherwise(F.concat(F.lit("fallback:"), F.coalesce("method", F.lit("rules"))))
    return rows.withColumns({"confidence": F.coalesce(F.col("confidence"), F.element_at(base, F.col("kind"))), "generator": generator})


#: Default confidences of a model's candidates.
MODEL_CONFIDENCE = {"entity": 0.75, "relation": 0.7, "statement": 0.65}
