"""Registries of types and rules from YAML files: configuration, read on the driver."""

from __future__ import annotations

import json
from pathlib import Path
from typing import Any

import yaml
from pyspark.sql import DataFrame, SparkSession, functions as F

ROWS = "file string, section string, code string, name string, body string"


def load(spark: SparkSession, folder: str) -> DataFrame:
    """file, section, code, name, body (JSON) of every coded item of the folder's YAML files, in the order of their paths."""
    rows = []
    for path in sorted(Path(folder).rglob("*.yaml")):
        content: Any = yaml.safe_load(path.read_text("utf-8"))
        for section, items in content.items() if isinstance(content, dict) else ():
            for x in items if isinstance(items, list) else ():
                if isinstance(x, dict) and x.get("code"):
                    rows.append((path.relative_to(folder).as_posix(), section, str(x["code"]), x.get("name"), json.dumps(x, ensure_ascii=False, sort_keys=True, default=str)))
    return spark.createDataFrame(rows, ROWS)


def faults(registry: DataFrame, entities: str = "entities", relations: str = "relations") -> DataFrame:
    """problem, code, detail: codes given twice in a section, and relations whose domain or range names no entity type."""
    twice = registry.groupBy("section", "code").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("repeated code").alias("problem"), "code", F.col("section").alias("detail"))
    types = registry.where(F.col("section") == entities).select(F.col("code").alias("detail")).distinct()
    out = twice
    for side in ("domain", "range"):
        ends = registry.where(F.col("section") == relations).select("code", F.explode(F.from_json(F.get_json_object("body", f"$.{side}"), "array<string>")).alias("detail"))
        out = out.unionByName(ends.join(types, "detail", "left_anti").select(F.lit(f"unknown {side}").alias("problem"), "code", "detail"))
    return out
