"""The registry's files as tables: items, the references between them, what is wrong with them, an export and a keyed seed."""

from __future__ import annotations

import json
from functools import reduce
from pathlib import Path
from typing import Any

import yaml
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from kgspark.operators.governance import chains
from kgspark.operators.store import upsert_rows

ITEM = "kind string, profile string, code string, layer string, ident string, file string, body string"
LINK = "kind string, profile string, code string, field string, target_kind string, target string"
# fixed values: sections of the files with the kind of their items and the field that holds an item's code and its own identifier
SECTIONS = {
    "entity_types": ("entity", "type", "type_id"), "relation_types": ("relation", "relation", "relation_id"), "metrics": ("metric", "metric", "metric_id"), "assertion_types": ("assertion", "code", None),
    "context_types": ("context", "code", None), "quality_metrics": ("quality", "code", None), "operation_roles": ("role", "role", None), "narrative_chains": ("chain", "chain_id", None),
}
# fixed values: references of an item to others: kind, field of the item, kind of the target
REFERENCES = (("relation", "subject_types", "entity"), ("relation", "object_types", "entity"), ("entity", "parent_type", "entity"), ("context", "required_for", "assertion"), ("chain", "layer", "profile"), ("profile", "inheritance", "profile"), ("extraction", "profile", "profile"))
ROLES = ("producer", "validator", "consumer", "governor")
WRITE_MODES = ("read_only", "candidate_only", "proposal_only")


def _dump(x: Any) -> str:
    return json.dumps(x, ensure_ascii=False, sort_keys=True, default=str)


def items(spark: SparkSession, folder: str) -> DataFrame:
    """Items (ITEM) of a folder's YAML files; a file's profile is its meta.profile_id or profile_id. Operations of roles, nested protocols and profile files are items too."""
    rows: list[tuple] = []

    def add(kind: str, profile: str | None, code: Any, layer: Any, ident: Any, file: str, body: Any) -> None:
        rows.append((kind, profile, str(code), None if layer is None else str(layer), None if ident is None else str(ident), file, _dump(body)))

    for path in sorted(Path(folder).rglob("*.yaml")):
        content = yaml.safe_load(path.read_text("utf-8"))
        if not isinstance(content, dict):
            continue
        file, meta = path.relative_to(folder).as_posix(), content.get("meta") or {}
        profile = content.get("profile_id") or meta.get("profile_id")
        if content.get("profile_id"):
            add("profile", profile, profile, content.get("layer"), profile, file, content)
        for section, (kind, code, ident) in SECTIONS.items():
            for x in content.get(section) or ():
                if isinstance(x, dict) and x.get(code):
                    add(kind, profile, x[code], x.get("layer"), x.get(ident) if ident else None, file, x)
                    for op in x.get("operations") or () if kind == "role" else ():
                        own = op if isinstance(op, dict) else {"code": op, "input": None, "output": None}
                        add("operation" if isinstance(op, dict) else "operation_use", profile, own.get("code"), None, x[code], file, own | {"role": x[code], "write_mode": x.get("write_mode")})
                    for nested in ("update_protocol", "retrieval_contract"):
                        if x.get(nested):
                            add(nested, profile, nested, None, None, file, x[nested])
        for nested in ("update_protocol", "retrieval_contract"):
            if content.get(nested):
                add(nested, profile, nested, None, None, file, content[nested])
        for name in content.get("profile_extraction_rules") or {}:
            add("extraction", profile, name, None, None, file, {"profile": [name]})
    return spark.createDataFrame(rows, ITEM)


def links(reg: DataFrame) -> DataFrame:
    """References (LINK) of items; a reference of an item of a profile to an entity is to the same profile's."""

    def listed(field: str) -> Column:
        value = F.get_json_object("body", f"$.{field}")
        many = F.from_json(value, "array<string>")
        return F.when(value.startswith("["), many).when(value != "", F.array(value))

    parts = [reg.where(F.col("kind") == kind).select("kind", "profile", "code", F.lit(field).alias("field"), F.lit(to).alias("target_kind"), F.explode(listed(field)).alias("target")) for kind, field, to in REFERENCES]
    uses = reg.where("kind = 'operation_use'").select(F.lit("role").alias("kind"), "profile", F.col("ident").alias("code"), F.lit("operations").alias("field"), F.lit("operation").alias("target_kind"), F.col("code").alias("target"))
    return reduce(DataFrame.unionByName, [*parts, uses])


def faults(reg: DataFrame) -> DataFrame:
    """check, profile, code, detail of what is wrong with items and the references between them; empty for a sound registry."""
    body = lambda path: F.get_json_object("body", f"$.{path}")
    none = lambda path: F.coalesce(body(path).isin("", "[]", "{}", "null"), F.lit(True))
    row = lambda df, check, detail: df.select(F.lit(check).alias("check"), "profile", "code", detail.cast("string").alias("detail"))
    of = lambda *kinds: reg.where(F.col("kind").isin(*kinds))
    profiles = of("profile").select(F.col("code").alias("kg_p"), F.col("layer").alias("kg_layer"))
    owned = of("entity", "relation", "metric").join(profiles, F.col("profile") == F.col("kg_p"))
    kinds = owned.select("kg_p", "kind").distinct().groupBy("kg_p").agg(F.collect_set("kind").alias("have"))
    short = of("profile").join(kinds, F.col("code") == F.col("kg_p"), "left").withColumn("lacks", F.array_sort(F.array_except(F.array(*map(F.lit, ("entity", "metric", "relation"))), F.coalesce("have", F.array().cast("array<string>")))))
    named = links(reg)
    known = reg.select(F.col("kind").alias("target_kind"), F.col("code").alias("target"), F.col("profile").alias("kg_of")).distinct()
    same = (named["target_kind"] == known["target_kind"]) & (named["target"] == known["target"]) & ((named["target_kind"] != "entity") | named["profile"].eqNullSafe(known["kg_of"]))
    unknown = named.join(known, same, "left_anti")
    up = named.where("field in ('parent_type', 'inheritance')").groupBy("kind", "profile", "code").agg(F.min("target").alias("target"))
    key = lambda c: F.concat_ws("/", "kind", F.coalesce("profile", F.lit("")), c) if c != "profile" else c
    own = lambda c: F.when(F.col("kind") == "profile", F.concat_ws("/", "kind", c)).otherwise(key(c))
    loops = chains(of("entity", "profile").select("kind", "profile", "code").distinct().join(up, ["kind", "profile", "code"], "left").select(own("code").alias("id"), F.when(F.col("target").isNotNull(), own("target")).alias("up")).dropDuplicates(["id"]), "id", "up")
    twice = reg.where("kind <> 'operation_use'").groupBy("kind", "profile", "code").agg(F.count("*").alias("n")).where("n > 1")
    required = F.coalesce(F.from_json(body("context_package.required_fields"), "array<string>"), F.array().cast("array<string>"))
    life = F.from_json(body("change_lifecycle"), "array<string>")
    found = [
        row(of("profile").where(F.coalesce(body("cross_layer_access"), F.lit("false")) != "false"), "cross_layer_access", F.lit("must be false")), row(short.where(F.size("lacks") > 0), "incomplete_profile", F.array_join("lacks", ",")),
        row(owned.where(~F.col("layer").eqNullSafe(F.col("kg_layer"))), "wrong_layer", F.col("kind")), row(owned.where((F.col("kind") != "metric") & ~F.col("ident").eqNullSafe(F.concat_ws(".", "profile", "code"))), "invalid_id", F.col("kind")),
        row(of("metric").where(~none("external_layer_dependencies")), "other_layer", F.lit("metric")), row(of("assertion").where(none("name")), "no_name", F.col("kind")),
        row(of("operation").where(none("input") | none("output")), "no_input_or_output", F.col("ident")), row(of("operation", "role").where(~F.coalesce(body("write_mode").isin(*WRITE_MODES), F.lit(False))), "write_mode", F.col("kind")),
        row(of("role").where(~F.col("code").isin(*ROLES)), "unknown_role", F.lit("role")), row(of("retrieval_contract").where(~F.array_contains(required, "query") | ~F.array_contains(required, "assertions")), "retrieval_contract", F.lit("query and assertions are required")),
        row(of("update_protocol").where(~F.coalesce((F.get(life, F.lit(0)) == "draft") & (F.element_at(life, -1) == "rejected"), F.lit(False))), "lifecycle", F.lit("draft to rejected")),
        row(unknown, "unknown_reference", F.concat_ws(" ", "field", "target")), row(twice, "repeated_code", F.col("kind")),
        loops.where("root is null").select(F.lit("parent_cycle").alias("check"), F.lit(None).cast("string").alias("profile"), F.element_at(F.split("id", "/"), -1).alias("code"), F.element_at(F.split("id", "/"), 1).alias("detail")),
    ]
    return reduce(DataFrame.unionByName, found)


def export(reg: DataFrame) -> str:
    """The registry as one JSON text, in an order and form that depend on its items only: configuration, so small."""
    out: dict[str, Any] = {}
    for r in reg.orderBy("kind", F.coalesce("profile", F.lit("")), "code", "body").collect():
        out.setdefault(r.kind, {}).setdefault(r.profile or "", {})[r.code] = json.loads(r.body)
    return json.dumps(out, ensure_ascii=False, sort_keys=True, indent=1) + "\n"


SEED = "type_code string, kind string, canonical_name string, definition string, version string, status string, body string"


def seeded(old: DataFrame, reg: DataFrame) -> DataFrame:
    """The type table (SEED) after the registry's entity and relation types came in: known codes are brought up to date, new ones added, none deleted. Doing it again changes nothing."""
    body = lambda path: F.get_json_object("body", f"$.{path}")
    code = F.coalesce("ident", F.concat_ws(".", "profile", "code"))
    new = reg.where("kind in ('entity', 'relation')").select(
        code.alias("type_code"), "kind", F.coalesce(body("canonical_name"), body("type"), body("relation")).alias("canonical_name"), F.coalesce(body("definition"), body("description"), code).alias("definition"),
        F.coalesce(body("version"), F.lit("1.0.0")).alias("version"), F.lit("active").alias("status"), "body", "file",
    )
    return upsert_rows(old, new, "type_code", ["file", "body"], ("kind", "canonical_name", "definition", "version", "status", "body"))
