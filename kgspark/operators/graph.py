"""Graph reads and projections over entity and relation tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from kgspark.session import Scratch, materialise


def top_nodes(entities: DataFrame, limit: int, layer: str | None = None, brand: str | None = None) -> DataFrame:
    """Active nodes of a layer (and of a brand or none), newest first; ties go by id."""
    rows = entities.where("status = 'active'")
    if layer:
        rows = rows.where(F.col("layer") == layer)
    if brand:
        rows = rows.where((F.col("brand_id") == brand) | F.col("brand_id").isNull())
    return rows.orderBy(F.desc("updated_at"), "id").limit(limit)


def induced(relations: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose two ends are among nodes."""
    ids = nodes.select("id").distinct()
    return relations.join(ids, relations["source_id"] == ids["id"], "left_semi").join(ids, F.col("target_id") == ids["id"], "left_semi")


def touching(statements: DataFrame, nodes: DataFrame) -> DataFrame:
    """Statements whose subject or object is among nodes: two semi joins, each row once."""
    ids = nodes.select("id").distinct()
    by_subject = statements.join(ids, F.col("subject_id") == ids["id"], "left_semi")
    rest = statements.join(ids, F.col("subject_id") == ids["id"], "left_anti")
    return by_subject.unionByName(rest.join(ids, F.col("object_id") == ids["id"], "left_semi"))


def view(entities: DataFrame, relations: DataFrame, limit: int, layer: str | None = None) -> DataFrame:
    """Nodes and induced edges as rows (kind, id, a, b, label); edges newest first, twice as many as nodes at most."""
    nodes = top_nodes(entities, limit, layer)
    edges = induced(relations, nodes).orderBy(F.desc("created_at"), "source_id", "target_id", "relation_type").limit(2 * limit)
    n = nodes.select(F.lit("node").alias("kind"), "id", F.col("type").alias("a"), F.col("name").alias("b"), F.col("layer").alias("label"))
    e = edges.select(F.lit("edge").alias("kind"), F.concat_ws(">", "source_id", "target_id").alias("id"), F.col("source_id").alias("a"), F.col("target_id").alias("b"), F.col("relation_type").alias("label"))
    return n.unionByName(e)


def with_ends(relations: DataFrame, entities: DataFrame, columns: list[str]) -> DataFrame:
    """Edges with columns of both end nodes (source_<c>, target_<c>); edges that lack an end are dropped."""
    s = entities.select(F.col("id").alias("sid"), *[F.col(c).alias(f"source_{c}") for c in columns])
    t = entities.select(F.col("id").alias("tid"), *[F.col(c).alias(f"target_{c}") for c in columns])
    return relations.join(s, F.col("source_id") == F.col("sid")).join(t, F.col("target_id") == F.col("tid")).drop("sid", "tid")


def orphans(entities: DataFrame, relations: DataFrame) -> DataFrame:
    ends = relations.select(F.col("source_id").alias("e")).unionByName(relations.select(F.col("target_id").alias("e"))).distinct()
    return entities.join(ends, F.col("id") == F.col("e"), "left_anti")


def neighbours(seeds: DataFrame, relations: DataFrame) -> DataFrame:
    """Seeds and nodes one edge away: id."""
    ids = seeds.select("id").distinct()
    out = relations.join(ids, F.col("source_id") == ids["id"], "left_semi").select(F.col("target_id").alias("id"))
    into = relations.join(ids, F.col("target_id") == ids["id"], "left_semi").select(F.col("source_id").alias("id"))
    return ids.unionByName(out).unionByName(into).distinct()


def paths(entities: DataFrame, relations: DataFrame, types: list[str]) -> DataFrame:
    """Chains of nodes of the given types, one edge apart in either direction: n0, n1, ..."""
    kinds = entities.select("id", "type")
    both = relations.select(F.col("source_id").alias("u"), F.col("target_id").alias("v")).unionByName(relations.select(F.col("target_id").alias("u"), F.col("source_id").alias("v"))).distinct()
    rows = kinds.where(F.col("type") == types[0]).select(F.col("id").alias("n0"))
    for k, t in enumerate(types[1:], 1):
        ends = kinds.where(F.col("type") == t).select(F.col("id").alias(f"n{k}"))
        rows = rows.join(both, F.col(f"n{k - 1}") == F.col("u")).drop("u").withColumnRenamed("v", f"n{k}").join(ends, f"n{k}", "left_semi")
    return rows.select(*[f"n{k}" for k in range(len(types))])


def snapshot_events(old: DataFrame, new: DataFrame, key: str, changed: Column) -> DataFrame:
    """Outbox events between two snapshots: active rows that came or changed are upserts; rows that left, or left active, are deletes."""
    o, n = old.alias("o"), new.alias("n")
    both = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    was, is_ = F.coalesce(F.col("o.status") == "active", F.lit(False)), F.coalesce(F.col("n.status") == "active", F.lit(False))
    event = F.when(is_ & (~was | changed), "upsert").when(was & ~is_, "delete")
    return both.select(F.coalesce(f"n.{key}", f"o.{key}").alias(key), event.alias("event_type")).where("event_type is not null")


def latest(events: DataFrame, key: str, *order: str) -> DataFrame:
    """The last event of each key."""
    cols = [c for c in events.columns if c != key]
    return events.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("l")).select(key, "l.*")


def domain_range(relations: DataFrame, entities: DataFrame, ontology: DataFrame) -> DataFrame:
    """Edges whose end types the ontology (relation_type, source_type, target_type) doesn't allow."""
    return with_ends(relations, entities, ["type"]).join(F.broadcast(ontology), ["relation_type", "source_type", "target_type"], "left_anti")


def merge_latest(old: DataFrame, new: DataFrame, key: list[str], order: str) -> DataFrame:
    """Keyed upsert of snapshots: of the rows of a key, the one with the greatest order; new wins ties."""
    rows = old.withColumn("kg_new", F.lit(0)).unionByName(new.withColumn("kg_new", F.lit(1)))
    cols = [c for c in old.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*cols), F.struct(order, "kg_new")).alias("r")).select(*key, "r.*").select(*old.columns)


def replace_documents(old: DataFrame, new: DataFrame, documents: DataFrame, key: str = "document_id") -> DataFrame:
    """A table in which the rows of the given documents are replaced by new ones."""
    return old.join(documents.select(key).distinct(), key, "left_anti").unionByName(new)


def bidirectional(relations: DataFrame, types: list[str]) -> DataFrame:
    """Relations with the inverse of each one of the given types, each edge once."""
    back = relations.where(F.col("relation_type").isin(types)).withColumnsRenamed({"source_id": "kg_s", "target_id": "source_id"}).withColumnRenamed("kg_s", "target_id")
    return relations.unionByName(back).dropDuplicates(["source_id", "target_id", "relation_type"])


def cited(entities: DataFrame, relations: DataFrame, units: DataFrame, spans: DataFrame, documents: DataFrame, limit: int = 500, layer: str | None = None, brand: str | None = None, first: int = 10) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a graph read with citations: the newest active nodes, the newest edges among them, twice as many at most.

    Nodes: id, type, name, layer, brand_id, citations; edges: id, source_id, target_id, type, confidence, citations. A citation (document_id, title, unit_id, char_start, char_end) is a
    reference of evidence_refs (array of document_id and unit_id) that a unit of the store bears; an edge's references without a document are to its own. The first ones of an item by document and unit.
    Only references of what is shown are resolved.
    """
    nodes = top_nodes(entities, limit, layer, brand)
    edges = induced(relations, nodes).orderBy(F.desc("created_at"), "source_id", "target_id", "relation_type").limit(2 * limit)
    refs = lambda df, kind, own: df.select(F.lit(kind).alias("kind"), F.col("id").alias("item"), own.alias("own"), F.explode("evidence_refs").alias("r")).select("kind", "item", F.coalesce("r.document_id", "own").alias("document_id"), "r.unit_id")
    asked = refs(nodes, "node", F.lit(None).cast("string")).unionByName(refs(edges, "edge", F.col("document_id"))).distinct()
    held = units.join(asked.select("document_id", "unit_id").distinct(), ["document_id", "unit_id"], "left_semi").select("document_id", "unit_id", F.explode("source_span_ids").alias("span_id"))
    places = held.join(spans.select("document_id", "span_id", "char_start", "char_end"), ["document_id", "span_id"]).groupBy("document_id", "unit_id").agg(F.min("char_start").alias("char_start"), F.max("char_end").alias("char_end"))
    found = asked.join(places, ["document_id", "unit_id"]).join(documents.select("document_id", "title"), "document_id", "left")
    listed = found.groupBy("kind", "item").agg(F.slice(F.array_sort(F.collect_list(F.struct("document_id", "unit_id", "title", "char_start", "char_end"))), 1, first).alias("citations"))
    none = F.array().cast(listed.schema["citations"].dataType)
    to = lambda df, kind: df.join(listed.where(F.col("kind") == kind).select(F.col("item").alias("id"), "citations"), "id", "left").withColumn("citations", F.coalesce("citations", none))
    return to(nodes, "node").select("id", "type", "name", "layer", "brand_id", "citations"), to(edges, "edge").select("id", "source_id", "target_id", F.col("relation_type").alias("type"), "confidence", "citations")


def cited_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One JSON text {nodes, edges, stats} of what cited() gives (bounded by its limit)."""
    packed = lambda df, name: df.select(F.struct(*df.columns).alias("x")).agg(F.array_sort(F.collect_list("x")).alias(name))
    one = packed(nodes, "nodes").crossJoin(packed(edges, "edges"))
    return one.select(F.to_json(F.struct("nodes", "edges", F.struct(F.size("nodes").alias("nodes"), F.size("edges").alias("edges")).alias("stats"))).alias("value"))


def ancestors(parents: DataFrame) -> DataFrame:
    """id, ancestor, depth for every chain of parents (id, parent), of any length; ValueError for a cycle.

    Reach doubles each round: what is known of the ancestors within d steps gives those within 2 d, and a round is written, so a chain of n takes log n rounds. A
    cycle is the only way for an id to reach itself, which the round that closes it shows.
    """
    up = parents.where("parent is not null").select("id", "parent").distinct()
    with Scratch(parents.sparkSession, "ancestors") as s:
        known, reach = s.write(up.select("id", F.col("parent").alias("ancestor"), F.lit(1).cast("bigint").alias("depth")), "steps"), 1
        while True:
            if not known.where("id = ancestor").isEmpty():
                raise ValueError("parents form a cycle")
            end = known.where(F.col("depth") == reach)
            if end.isEmpty():
                return materialise(known.withColumn("depth", F.col("depth").cast("int")), "ancestors")
            more = end.select("id", F.col("ancestor").alias("at")).join(known.select(F.col("id").alias("at"), "ancestor", F.col("depth").alias("kg_d")), "at").select("id", "ancestor", (F.col("kg_d") + reach).alias("depth"))
            known, reach = s.write(known.unionByName(more).distinct(), "reach"), 2 * reach
