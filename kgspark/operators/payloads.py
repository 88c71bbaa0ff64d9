"""Model answers in JSON, brought into one shape: expressions on each row, without joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from kgspark.functions.exprs import json_object_text, normalize_name, normalize_text

ENTITY = "struct<type:string,entity_type:string,canonical_name:string,name:string,id:string,entity_id:string,confidence:double>"
RELATION = "struct<relation:string,type:string,subject:string,object:string,subject_type:string,object_type:string,entity_type_subject:string,entity_type_object:string,confidence:double>"
STATEMENT = "struct<text:string,statement_class:string,confidence:double>"
SCHEMA = f"struct<entities:array<{ENTITY}>,relations:array<{RELATION}>,statements:array<{STATEMENT}>>"
KINDS = ("entities", "relations", "statements")


def _first(*values: Column) -> Column:
    return F.coalesce(*[F.when(v != "", v) for v in values])


def _error(text: Column) -> Column:
    """Why a payload is refused, or null: no object, or a collection that isn't an array of objects."""
    out = F.when(F.try_parse_json(text).isNull(), "not JSON")
    for kind in KINDS:
        v = F.get_json_object(text, f"$.{kind}")
        items = F.from_json(v, "array<string>")
        empty = v.isNull() | v.isin("", "0", "false", "{}")
        out = out.when(~empty & ~v.startswith("["), f"{kind} must be an array")
        out = out.when(~empty & F.exists(items, lambda x: x.isNull() | ~x.startswith("{")), f"{kind} must contain objects")
    return out


def _entities(parsed: Column) -> Column:
    def one(e: Column, i: Column) -> Column:
        name = _first(e["canonical_name"], e["name"])
        made = F.when(name.isNotNull(), F.concat(F.lit("llm-entity-"), i.cast("string")))
        return F.struct(F.coalesce(_first(e["id"], e["entity_id"]), made).alias("id"), _first(e["type"], e["entity_type"]).alias("type"), name.alias("name"), e["confidence"].alias("confidence"))

    return F.transform(F.coalesce(parsed["entities"], F.array().cast(f"array<{ENTITY}>")), one)


def _relations(parsed: Column, entities: Column) -> Column:
    known = F.reverse(F.filter(entities, lambda e: e["id"].isNotNull() & e["name"].isNotNull()))  # of a name's entities the last counts
    by_id = lambda v: F.get(F.filter(known, lambda e: e["id"] == v), F.lit(0))
    by_name = lambda v: F.get(F.filter(known, lambda e: normalize_name(e["name"]) == normalize_name(v)), F.lit(0))

    def end(value: Column, hint: Column) -> tuple[Column, Column]:
        part = lambda *names: _first(*[F.get_json_object(value, f"$.{n}") for n in names])
        nested = value.startswith("{")
        owner = by_id(part("id", "entity_id"))
        name = F.when(nested, F.coalesce(part("canonical_name", "name", "entity"), owner["name"])).otherwise(value)
        kind = F.when(nested, F.coalesce(part("type", "entity_type"), hint, owner["type"])).otherwise(hint)
        name = _first(normalize_text(name))
        hit = F.coalesce(by_id(name), by_name(name))
        return F.coalesce(hit["id"], name, value, F.lit("")), F.coalesce(kind, hit["type"])

    def one(r: Column) -> Column:
        s, st = end(r["subject"], _first(r["subject_type"], r["entity_type_subject"]))
        o, ot = end(r["object"], _first(r["object_type"], r["entity_type_object"]))
        return F.struct(s.alias("subject"), st.alias("subject_type"), _first(r["relation"], r["type"]).alias("relation"), o.alias("object"), ot.alias("object_type"), r["confidence"].alias("confidence"))

    return F.transform(F.coalesce(parsed["relations"], F.array().cast(f"array<{RELATION}>")), one)


def folded(rows: DataFrame, answer: str) -> DataFrame:
    """Adds error, entities, relations and statements to rows with a model's answer.

    Names of fields and ways to give a relation's ends (id, name, nested
    object) are brought together; ends that can't be resolved stay as they are. A refused answer has an error and null collections.
    """
    text = json_object_text(F.coalesce(answer, F.lit("")))
    rows = rows.withColumn("error", _error(text)).withColumn("kg_parsed", F.when(F.col("error").isNull(), F.from_json(text, SCHEMA)))
    rows = rows.withColumn("entities", F.when(F.col("error").isNull(), _entities(F.col("kg_parsed"))))
    rows = rows.withColumn("relations", F.when(F.col("error").isNull(), _relations(F.col("kg_parsed"), F.col("entities"))))
    return rows.withColumn("statements", F.col("kg_parsed.statements")).drop("kg_parsed")
