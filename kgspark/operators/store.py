"""Writes as new snapshots: document bundles, entity properties, pending events, embeddings, migrations; and whole snapshots on disk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from kgspark.functions.exprs import stable_id
from kgspark.operators import snapshots

#: Tables whose rows belong to one document and are replaced with it.
OWNED = ("relations", "statements", "candidates", "units", "spans")


# --- documents in ---


def text_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Each UTF-8 file is a document: document_id, title (the file's name), content, source_path, content_hash. Blank files are left out."""
    name = F.element_at(F.split(F.col("source_path"), "/"), -1)
    rows = spark.read.text(paths, wholetext=True).select(F.col("value").alias("content"), F.input_file_name().alias("source_path"))
    return _documents(rows.withColumn("title", F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))))


def inline_texts(rows: DataFrame, title: str = "Untitled") -> DataFrame:
    """Documents of rows (title, content): a null or blank title takes the default, blank contents are left out."""
    given = F.when(F.trim("title") != "", F.trim("title"))
    return _documents(rows.select("content", F.coalesce(given, F.lit(title)).alias("title"), F.lit(None).cast("string").alias("source_path")))


def _documents(rows: DataFrame) -> DataFrame:
    rows = rows.where(F.col("content").rlike(r"(?U)\S")).withColumn("content_hash", F.sha2("content", 256))
    return rows.select(stable_id("doc", "content_hash").alias("document_id"), "title", "content", "source_path", "content_hash")


# --- property merge ---


def ordered_union(*arrays: Column) -> Column:
    """Values of arrays in the order they first stand there; null arrays count as empty."""
    empty = F.array().cast("array<string>")
    return F.array_distinct(F.concat(*[F.coalesce(a, empty) for a in arrays]))


def merged_properties(old: Column, new: Column) -> Column:
    """Properties (struct: scalars map, source_document_id, source_document_ids, aliases, evidence_refs) of an entity that another document mentions.

    New scalars win. Sources keep the order they came in, and the first one stays the source; aliases and references are joined.
    """
    empty = F.create_map().cast("map<string,string>")
    one = lambda c: F.when(c.isNotNull() & (c != ""), F.array(c))
    sources = ordered_union(old["source_document_ids"], one(old["source_document_id"]), new["source_document_ids"], one(new["source_document_id"]))
    kept, fresh = F.coalesce(old["scalars"], empty), F.coalesce(new["scalars"], empty)
    scalars = F.map_concat(F.map_filter(kept, lambda k, _: ~F.array_contains(F.map_keys(fresh), k)), fresh)
    return F.struct(
        scalars.alias("scalars"), F.get(sources, F.lit(0)).alias("source_document_id"), sources.alias("source_document_ids"),
        ordered_union(old["aliases"], new["aliases"]).alias("aliases"), ordered_union(old["evidence_refs"], new["evidence_refs"]).alias("evidence_refs"),
    )


#: Columns of an entity that its newest mention gives; the others stay as its first mention, or the store, has them.
NEWEST = ("name", "normalized_name", "updated_at")


def fold_entities(old: DataFrame, mentions: DataFrame, order: list[str], key: str = "id", newest: tuple[str, ...] = NEWEST, place: str | None = None) -> DataFrame:
    """Entities after all mentions of a batch, as if its documents came in one by one: old (key, properties, ...), mentions (the same columns, and those of `order`).

    Each mention merges into what is there as merged_properties() says: a scalar has its last value, sources, aliases and references stand in the order they were first
    seen, whoever mentions the entity for the first time included. Empty source ids count for nothing. Entities without a mention stay as they are. Of mentions
    equal in `order` (order should tell them apart) the one with the greater values counts as later; with `place` (a number of theirs) the one with the least place decides
    all columns, and values first seen at once stand in the order of the least place that holds them at all. Rows with a null key are left out.

    The fold is made of associative steps (first place of a value, last value of a scalar), so all but distinct values is summed up before it moves and an
    entity with any share of the mentions has no task to itself.
    """
    cols = [c for c in old.columns if c != key]
    fixed, last = [c for c in cols if c not in (*newest, "properties")], [c for c in cols if c in newest]
    came = mentions.where(F.col(key).isNotNull()).select(F.col(key), *cols, (F.col(place).cast("long") if place else F.lit(0).cast("long")).alias("kg_place"), F.struct(F.lit(1).alias("kg_new"), *[F.col(c).alias(f"kg_o{i}") for i, c in enumerate(order)]).alias("kg_at"))
    touched = came.select(key).distinct()
    there = old.join(touched, key, "left_semi").select(F.col(key), *cols, F.lit(-1).cast("long").alias("kg_place"), F.struct(F.lit(0).alias("kg_new"), *[F.lit(None).cast(mentions.schema[c].dataType).alias(f"kg_o{i}") for i, c in enumerate(order)]).alias("kg_at"))
    rows = there.unionByName(came)
    p = F.col("properties")
    one = lambda c: F.when(c.isNotNull() & (c != ""), F.array(c)).otherwise(F.array().cast("array<string>"))
    listed = lambda a: F.coalesce(a, F.array().cast("array<string>"))
    scalars = F.coalesce(p["scalars"], F.create_map().cast("map<string,string>"))
    cell = lambda field, at, name, value: F.struct(F.lit(field).alias("field"), at.cast("int").alias("place"), name.cast("string").alias("name"), value.cast("string").alias("value"))
    many = lambda field, a: F.transform(a, lambda v, i: cell(field, i, v, F.lit(None)))
    cells = F.concat(
        many("source", F.filter(F.concat(listed(p["source_document_ids"]), one(p["source_document_id"])), lambda v: v.isNotNull() & (v != ""))), many("alias", listed(p["aliases"])), many("ref", listed(p["evidence_refs"])),
        F.transform(F.map_entries(scalars), lambda e: cell("scalar", F.lit(0), e["key"], e["value"])),
    )
    parts = rows.select(key, "kg_at", "kg_place", F.explode(cells).alias("c")).select(key, "kg_at", "kg_place", "c.*")
    late = (-F.col("kg_place")).alias("kg_late")
    seen = parts.groupBy(key, "field", "name").agg(F.min(F.struct("kg_at", "place")).alias("first"), F.min("kg_place").alias("row"), F.max(F.struct("kg_at", late, "value")).alias("last"))
    of = lambda field: F.transform(F.array_sort(F.collect_list(F.when(F.col("field") == field, F.struct("first", "row", "name")))), lambda x: x["name"])
    props = seen.groupBy(key).agg(
        F.map_from_entries(F.collect_list(F.when(F.col("field") == "scalar", F.struct("name", "last.value")))).alias("kg_scalars"), of("source").alias("kg_sources"), of("alias").alias("kg_aliases"), of("ref").alias("kg_refs"),
    )
    ends = rows.groupBy(key).agg(F.min("kg_at").alias("kg_at"), *[F.min_by(c, F.struct("kg_at", "kg_place")).alias(c) for c in fixed], *[F.max_by(c, F.struct("kg_at", late)).alias(c) for c in last])
    merged = F.struct(
        F.coalesce("kg_scalars", F.create_map().cast("map<string,string>")).alias("scalars"), F.get(listed(F.col("kg_sources")), F.lit(0)).alias("source_document_id"), listed(F.col("kg_sources")).alias("source_document_ids"),
        listed(F.col("kg_aliases")).alias("aliases"), listed(F.col("kg_refs")).alias("evidence_refs"),
    )
    done = ends.join(props, key, "left").withColumn("properties", merged).select(key, *cols)
    return old.join(touched, key, "left_anti").select(key, *cols).unionByName(done).select(*old.columns)


def upsert_rows(old: DataFrame, new: DataFrame, key: str, order: list[str], newest: tuple[str, ...]) -> DataFrame:
    """old after rows of new, in `order`: a known key takes the columns `newest` from its last row; all others stay as the store, or its first row, has them."""
    cols = [c for c in old.columns if c != key]
    at = F.struct(*order) if order else F.lit(0)
    ends = new.groupBy(key).agg(F.min_by(F.struct(*cols), at).alias("kg_first"), F.max_by(F.struct(*cols), at).alias("kg_last"))
    both = old.withColumn("kg_old", F.struct(*cols)).select(key, "kg_old").join(ends, key, "full")
    pick = lambda c: F.when(F.col("kg_old").isNull(), F.col("kg_first")[c]).otherwise(F.col("kg_old")[c])
    value = lambda c: F.when(F.col("kg_last").isNotNull(), F.col("kg_last")[c]).otherwise(F.col("kg_old")[c])
    return both.select(key, *[(value(c) if c in newest else pick(c)).alias(c) for c in cols]).select(*old.columns)


def merge_entities(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Entities after a batch in which none is mentioned twice: fold_entities() without an order."""
    return fold_entities(old, new, [], key)


# --- bundles ---


def absent_events(outbox: DataFrame, new: DataFrame, key: tuple[str, ...] = ("aggregate_type", "aggregate_id", "event_type")) -> DataFrame:
    """Events of new that no unprocessed event of the outbox equals, each once."""
    pending = outbox.where(~F.col("processed")).select(*key).distinct()
    return new.dropDuplicates(list(key)).join(pending, list(key), "left_anti")


def replace_bundle(store: dict[str, DataFrame], bundle: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The store after the bundle's documents came in (again): a new snapshot of each table.

    documents: title, content, source_path and updated_at are taken from the bundle, created_at stays. Rows that belong to
    its documents go, the bundle's come in; a relation that another document has already stays that document's and takes properties and confidence. Entities are folded, whichever
    and however many documents mention them: a column `ord` of theirs (and of relations) gives the order of documents and mentions. Each entity and relation of the bundle is an
    upsert event unless one is pending.
    """
    docs, new = store["documents"], bundle["documents"]
    ids = new.select("document_id").distinct()
    born = docs.select("document_id", F.col("created_at").alias("kg_born"))
    came = new.join(born, "document_id", "left").withColumn("created_at", F.coalesce("kg_born", "created_at")).select(*docs.columns)
    out = {"documents": docs.join(ids, "document_id", "left_anti").unionByName(came)}
    for name in OWNED:
        if name in store:
            kept = store[name].join(ids, "document_id", "left_anti")
            if name == "relations" and name in bundle:
                out[name] = upsert_rows(kept, bundle[name], "id", _order(bundle[name]), ("properties", "confidence"))
            else:
                out[name] = kept.unionByName(bundle[name]) if name in bundle else kept
    out["entities"] = fold_entities(store["entities"], bundle["entities"], _order(bundle["entities"])) if "entities" in bundle else store["entities"]
    events = [bundle[t].select(F.lit(kind).alias("aggregate_type"), F.col("id").alias("aggregate_id"), F.lit("upsert").alias("event_type"), F.lit(False).alias("processed")) for t, kind in (("entities", "entity"), ("relations", "relation")) if t in bundle]
    out["outbox"] = store["outbox"]
    for e in events:
        out["outbox"] = out["outbox"].unionByName(absent_events(store["outbox"], e), allowMissingColumns=True)
    return out


def _order(rows: DataFrame) -> list[str]:
    return ["ord"] if "ord" in rows.columns else []


def upsert_embeddings(old: DataFrame, new: DataFrame) -> DataFrame:
    """Embeddings after a batch: one row for each (source_id, source_type, model), the batch's last by created_at if it has one."""
    key = ["source_id", "source_type", "model"]
    cols = [c for c in old.columns if c not in key]
    last = new.groupBy(*key).agg(F.max_by(F.struct(*cols), "created_at").alias("r")).select(*key, "r.*").select(*old.columns)
    return old.join(last, key, "left_anti").unionByName(last)


def greatest_confidence(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Gate entities after a batch: other columns from the batch where it has a value, the greater confidence."""
    n = new.groupBy(*key).agg(*[F.max(c).alias(f"kg_{c}") for c in old.columns if c not in key])
    values = [(F.greatest(c, f"kg_{c}") if c == "confidence" else F.coalesce(f"kg_{c}", c)).alias(c) for c in old.columns if c not in key]
    return old.join(n, key, "full").select(*key, *values)


def misplaced_migrations(applied: DataFrame, known: list[str]) -> DataFrame:
    """Applied versions (position from 0, version) that aren't the known one of their place: applied ones must be a prefix."""
    names = F.array(*[F.lit(k) for k in known]).cast("array<string>")
    return applied.withColumn("expected", F.get(names, F.col("position"))).where(~F.col("expected").eqNullSafe(F.col("version")))


# --- snapshots on disk ---


def publish(tables: dict[str, DataFrame], folder: str) -> int:
    """Write a snapshot of all tables and make it the current one: readers see all of it or nothing (see snapshots for writers that share a store, backups and expiry)."""
    return snapshots.publish(next(iter(tables.values())).sparkSession, folder, tables)


def current(spark: SparkSession, folder: str, *names: str) -> dict[str, DataFrame]:
    """The tables of the snapshot published last."""
    tables = snapshots.read(spark, folder)
    return {n: tables[n] for n in names}


def differing_counts(left: dict[str, DataFrame], right: dict[str, DataFrame]) -> list[str]:
    """Names of tables whose copies differ in number of rows or in the sum of their rows' hashes."""
    return sorted(n for n in left if snapshots.fingerprint(left[n]) != snapshots.fingerprint(right[n]))


def graph_json(nodes: DataFrame, edges: DataFrame, statements: DataFrame, limit: int = 500) -> DataFrame:
    """One JSON text {nodes, edges, statements, stats} of at most `limit` nodes and statements and twice as many edges (the feature's own bounds)."""
    def packed(df: DataFrame, name: str, order: list[str], n: int) -> DataFrame:
        rows = df.orderBy(*order).limit(n).select(F.struct(*df.columns).alias("x"))
        return rows.agg(F.array_sort(F.collect_list("x")).alias(name))

    one = packed(nodes, "nodes", ["id"], limit).crossJoin(packed(edges, "edges", ["source_id", "target_id"], 2 * limit)).crossJoin(packed(statements, "statements", ["id"], limit))
    stats = F.struct(F.size("nodes").alias("nodes"), F.size("edges").alias("edges"), F.size("statements").alias("statements"))
    return one.select(F.to_json(F.struct("nodes", "edges", "statements", stats.alias("stats"))).alias("value"))
