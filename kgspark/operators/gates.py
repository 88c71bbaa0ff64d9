"""Fusion of candidates, promotion gates and validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def ordered_unique(values: Column, limit: int | None = None) -> Column:
    """First occurrences of an array of structs (ord, x) sorted by ord."""
    out = F.array_distinct(F.transform(F.array_sort(values), lambda v: v["x"]))
    return F.slice(out, 1, limit) if limit else out


def fuse(cands: DataFrame, key: str, order: list[str], refs: str, method: str, shape: list[str], most_refs: int = 20) -> DataFrame:
    """Candidates of one key become one row: the first member's shape, the greatest confidence (null counts as 0.5), methods and references in first-seen order."""
    at = F.struct(*order)
    return cands.groupBy(key).agg(
        *[F.min_by(c, at).alias(c) for c in shape], F.max(F.coalesce("confidence", F.lit(0.5))).alias("confidence"), F.count("*").alias("members"),
        ordered_unique(F.collect_set(F.struct(at.alias("ord"), F.col(method).alias("x")))).alias("methods"), ordered_unique(F.collect_set(F.struct(at.alias("ord"), F.col(refs).alias("x"))), most_refs).alias("refs"),
    )


def gates(rows: DataFrame, threshold: str = "0.750") -> DataFrame:
    """Adds gate_<name> (true: passed) for schema, ontology, evidence, duplicate, conflict and confidence. Confidences are compared as decimals."""
    return rows.withColumns({
        "gate_schema": F.coalesce("schema_valid", F.lit(False)), "gate_ontology": F.coalesce("type_known", F.lit(False)),
        "gate_evidence": F.coalesce(F.col("evidence_count") > 0, F.lit(False)), "gate_duplicate": ~F.coalesce("is_duplicate", F.lit(False)),
        "gate_conflict": ~F.coalesce("has_conflict", F.lit(False)), "gate_confidence": F.coalesce(F.col("confidence").cast("decimal(4,3)") >= F.lit(threshold).cast("decimal(4,3)"), F.lit(False)),
    })


#: Gates whose failure sends a row to review; the others reject.
REVIEW = ("gate_duplicate", "gate_conflict", "gate_confidence")


def disposition() -> Column:
    """promote without failures; review if a failing gate asks for it, whatever else failed; else reject."""
    names = ("gate_schema", "gate_ontology", "gate_evidence", "gate_duplicate", "gate_conflict", "gate_confidence")
    every = F.lit(True)
    for n in names:
        every = every & F.col(n)
    some = F.lit(False)
    for n in REVIEW:
        some = some | ~F.col(n)
    return F.when(every, "promote").when(some, "review").otherwise("reject")


def conflicts(rows: DataFrame, key: list[str], obj: str) -> DataFrame:
    """Groups with their members and distinct objects (null counts as one); more than one of each is a conflict."""
    g = rows.groupBy(*key).agg(F.count("*").alias("members"), F.count_distinct(F.coalesce(obj, F.lit("∅"))).alias("objects"))
    return g.withColumn("is_conflict", (F.col("members") > 1) & (F.col("objects") > 1))


def illegal_transitions(states: DataFrame, key: str, order: list[str], state: str, allowed: list[tuple[str, str]]) -> DataFrame:
    """Consecutive states of a key whose step isn't allowed."""
    from pyspark.sql import Window

    before = F.lag(state).over(Window.partitionBy(key).orderBy(*order))
    ok = F.concat_ws(">", "before", state).isin([f"{a}>{b}" for a, b in allowed])
    return states.withColumn("before", before).where(F.col("before").isNotNull() & (F.col("before") != F.col(state)) & ~ok)


def dangling(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Rows whose reference has no parent (nulls are no references)."""
    return child.where(F.col(column).isNotNull()).join(parent.select(F.col(key).alias("kg_parent")).distinct(), F.col(column) == F.col("kg_parent"), "left_anti")


def value_conflicts(rows: DataFrame, key: list[str], value: str, above: float = 0.2) -> DataFrame:
    """Groups of two or more values whose greatest exceeds the least by more than a share."""
    g = rows.groupBy(*key).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count("*").alias("n")).where("n >= 2 and lo > 0")
    return g.withColumn("is_conflict", F.col("hi") / F.col("lo") - 1 > above)


def valid_at(at: Column, start: Column, end: Column) -> Column:
    return (start <= at) & (end.isNull() | (end >= at))
