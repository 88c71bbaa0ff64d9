"""A sound registry has no faults; each check has an example that fails."""

import copy

import pytest
import yaml

from kgspark.sources import contracts

SOUND = {
    "ontology/a/entities.yaml": {"meta": {"profile_id": "a"}, "entity_types": [{"type": "brand", "type_id": "a.brand", "layer": "l2", "canonical_name": "Marke"}, {"type": "shop", "type_id": "a.shop", "layer": "l2", "parent_type": "brand"}]},
    "ontology/a/relations.yaml": {"meta": {"profile_id": "a"}, "relation_types": [{"relation": "owns", "relation_id": "a.owns", "layer": "l2", "subject_types": ["brand"], "object_types": ["shop"], "version": "2.0.0"}]},
    "ontology/a/metrics.yaml": {"meta": {"profile_id": "a"}, "metrics": [{"metric": "size", "metric_id": "a.size", "layer": "l2", "external_layer_dependencies": []}]},
    "schema_profiles/a.yaml": {"profile_id": "a", "layer": "l2", "inheritance": [], "cross_layer_access": False},
    "schema_profiles/rules.yaml": {"narrative_chains": [{"chain_id": "c", "layer": "a"}], "profile_extraction_rules": {"a": {"role": "x"}}},
    "contracts/g.yaml": {"assertion_types": [{"code": "fact", "name": "Fakt"}], "context_types": [{"code": "time", "required_for": ["fact"]}]},
    "contracts/p.yaml": {
        "operation_roles": [
            {"role": "producer", "write_mode": "candidate_only", "operations": [{"code": "extract", "input": ["d"], "output": ["e"]}]},
            {"role": "governor", "write_mode": "proposal_only", "operations": ["extract"], "update_protocol": {"change_lifecycle": ["draft", "rejected"]}, "retrieval_contract": {"context_package": {"required_fields": ["query", "assertions"]}}},
        ]
    },
}
ENT, REL, MET, PRO = "ontology/a/entities.yaml", "ontology/a/relations.yaml", "ontology/a/metrics.yaml", "contracts/p.yaml"
BROKEN = [
    ("schema_profiles/a.yaml", ("cross_layer_access",), True, "cross_layer_access", "a"), (MET, ("metrics",), [], "incomplete_profile", "a"), (ENT, ("entity_types", 0, "layer"), "l3", "wrong_layer", "brand"),
    (ENT, ("entity_types", 0, "type_id"), "b.brand", "invalid_id", "brand"), (REL, ("relation_types", 0, "object_types"), ["gone"], "unknown_reference", "owns"), (REL, ("relation_types", 0, "relation_id"), "x", "invalid_id", "owns"), (REL, ("relation_types", 0, "layer"), None, "wrong_layer", "owns"),
    (MET, ("metrics", 0, "layer"), "l9", "wrong_layer", "size"), (MET, ("metrics", 0, "external_layer_dependencies"), ["l3"], "other_layer", "size"), ("contracts/g.yaml", ("assertion_types", 0, "name"), "", "no_name", "fact"),
    ("contracts/g.yaml", ("context_types", 0, "required_for"), ["guess"], "unknown_reference", "time"), (PRO, ("operation_roles", 0, "operations", 0, "output"), [], "no_input_or_output", "extract"), (PRO, ("operation_roles", 1, "write_mode"), "all", "write_mode", "governor"),
    (PRO, ("operation_roles", 0, "role"), "boss", "unknown_role", "boss"), (PRO, ("operation_roles", 1, "operations"), ["gone"], "unknown_reference", "governor"), (PRO, ("operation_roles", 1, "retrieval_contract", "context_package", "required_fields"), ["query"], "retrieval_contract", "retrieval_contract"),
    (PRO, ("operation_roles", 1, "update_protocol", "change_lifecycle"), ["draft"], "lifecycle", "update_protocol"), ("schema_profiles/rules.yaml", ("profile_extraction_rules",), {"z": {}}, "unknown_reference", "z"), ("schema_profiles/rules.yaml", ("narrative_chains", 0, "layer"), "z", "unknown_reference", "c"),
    (ENT, ("entity_types", 0, "parent_type"), "shop", "parent_cycle", "brand"), ("schema_profiles/a.yaml", ("inheritance",), ["a"], "parent_cycle", "a"), (ENT, ("entity_types", 1, "type"), "brand", "repeated_code", "brand"),
]


def written(folder, files):
    for name, content in files.items():
        at = folder / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(yaml.safe_dump(content, allow_unicode=True), "utf-8")
    return str(folder)


def found(spark, folder):
    return {(r.check, r.code) for r in contracts.faults(contracts.items(spark, folder)).collect()}


def test_sound_registry(spark, tmp_path):
    reg = contracts.items(spark, written(tmp_path, SOUND))
    assert found(spark, str(tmp_path)) == set()
    assert contracts.export(reg) == contracts.export(contracts.items(spark, str(tmp_path)).repartition(3)) and "Marke" in contracts.export(reg)
    old = spark.createDataFrame([("a.brand", "entity", "old", "d", "0", "inactive", "{}"), ("z.gone", "entity", "kept", "d", "0", "active", "{}")], contracts.SEED)
    once = contracts.seeded(old, reg)
    rows = {r.type_code: r for r in once.collect()}
    assert sorted(rows) == ["a.brand", "a.owns", "a.shop", "z.gone"] and rows["a.brand"].canonical_name == "Marke" and rows["a.owns"].version == "2.0.0" and rows["z.gone"].canonical_name == "kept" and rows["a.brand"].status == "active"
    assert sorted(map(tuple, contracts.seeded(once, reg).collect())) == sorted(map(tuple, once.collect()))


@pytest.mark.parametrize("alone", [False, True])
def test_each_check_fails(spark, tmp_path, alone):
    files = copy.deepcopy(SOUND)
    cases = [b for b in BROKEN if (b[3] in ("incomplete_profile", "repeated_code")) == alone]  # these two would hide others
    for file, path, value, _, _ in cases:
        at = files[file]
        for k in path[:-1]:
            at = at[k]
        at[path[-1]] = value
    assert {b[3:] for b in cases} <= found(spark, written(tmp_path, files))
