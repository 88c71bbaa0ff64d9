"""Reads over the store: look-ups, document scope, counts, routing of questions, citations with titles, context text, and the API's reads."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from kgspark.operators import graph, retrieve

#: How a question names a brand or a document, and words that name none.
BRAND_BEFORE = r"([A-Za-z0-9_\-一-鿿]{1,64})\s*品牌"
BRAND_AFTER = r"品牌\s*(?:是|为|[:：])?\s*([A-Za-z0-9_\-一-鿿]{1,64})"
DOCUMENT = r"文档\s*(?:[:：]\s*)?([A-Za-z0-9_.\-]{1,128})"
NO_REFERENCE = ("的", "是", "有哪些", "什么")


def by_value(rows: DataFrame, column: str, value: str) -> DataFrame:
    return rows.where(F.col(column) == value)


def resolved(documents: DataFrame, reference: str) -> DataFrame:
    """document_id of the document with this id, or else title; ties go by id. One row at most."""
    hit = documents.where((F.col("document_id") == reference) | (F.col("title") == reference))
    return hit.orderBy(F.when(F.col("document_id") == reference, 0).otherwise(1), "document_id").limit(1).select("document_id")


def newest(rows: DataFrame, at: str, key: str, k: int) -> DataFrame:
    return rows.orderBy(F.desc(at), key).limit(k)


def in_document(entities: DataFrame, relations: DataFrame, statements: DataFrame, document_id: str) -> DataFrame:
    """Entities that come from a document: by their sources, as an end of one of its relations, or as the subject of one of its statements."""
    ends = relations.where(F.col("document_id") == document_id).select(F.explode(F.array("source_id", "target_id")).alias("id"))
    said = statements.where(F.col("document_id") == document_id).select(F.col("subject_id").alias("id"))
    own = entities.where(F.array_contains("source_document_ids", document_id)).select("id")
    return entities.join(own.unionByName(ends).unionByName(said).distinct(), "id", "left_semi")


def with_subject(statements: DataFrame, entities: DataFrame) -> DataFrame:
    """Statements with their subject's name and type, null where it has none."""
    e = entities.select(F.col("id").alias("subject_id"), F.col("name").alias("subject_name"), F.col("type").alias("subject_type"))
    return statements.join(e, "subject_id", "left")


def subjects(statements: DataFrame, mentions: DataFrame) -> DataFrame:
    """Statements with subject_id: their document's first brand, or else its first entity. mentions: document_id, entity_id, type, ord."""
    at = F.struct(F.when(F.col("type") == "brand", 0).otherwise(1).alias("k"), "ord", "entity_id")
    first = mentions.groupBy("document_id").agg(F.min_by("entity_id", at).alias("subject_id"))
    return statements.join(first, "document_id", "left")


def document_counts(documents: DataFrame, **tables: DataFrame) -> DataFrame:
    """document_id and a number of rows in each table (with document_id); documents without rows count 0."""
    out = documents.select("document_id").distinct()
    for name, rows in tables.items():
        out = out.join(rows.groupBy("document_id").agg(F.count("*").alias(name)), "document_id", "left")
    return out.select("document_id", *[F.coalesce(n, F.lit(0)).cast("bigint").alias(n) for n in tables])


def table_counts(**tables: DataFrame) -> DataFrame:
    """table, n: a row per table."""
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n") for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def entity_rollup(cands: DataFrame) -> DataFrame:
    """Entities of fused candidates: entity_type, normalized_name, name, refs, n; ends of relations (object_*) count too. Names are joined by their normal form."""
    side = lambda p: cands.where(F.col(f"{p}_name").isNotNull()).select(F.col(f"{p}_type").alias("entity_type"), F.col(f"{p}_name").alias("name"), "refs", "ord")
    rows = side("subject").unionByName(side("object")).withColumn("normalized_name", F.lower(F.regexp_replace(F.trim("name"), r"(?U)\s+", " ")))
    one = rows.groupBy("entity_type", "normalized_name").agg(F.min_by("name", F.struct("ord", "name")).alias("name"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("refs")))).alias("refs"), F.count("*").alias("n"))
    return one


def first_of(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("kg_k", F.row_number().over(w)).where("kg_k = 1").drop("kg_k")


# --- questions ---


@dataclass(frozen=True)
class Route:
    """What a question is answered by: nothing, plain (text search), overview, or scoped (filters alone)."""

    kind: str
    types: frozenset[str] = field(default_factory=frozenset)
    brand: str | None = None
    document: str | None = None


def brand_reference(question: str) -> str | None:
    if m := re.search(BRAND_BEFORE, question):
        return m[1]
    m = re.search(BRAND_AFTER, question)
    return m[1] if m and m[1] not in NO_REFERENCE else None


def document_reference(question: str) -> str | None:
    m = re.search(DOCUMENT, question)
    return m[1] if m else None


def route(question: str) -> Route:
    """How a question is read: a brand or document marker makes it scoped, an overview phrase without these an overview, else text is searched.

    A brand marker that names no brand gives brand "", which fits no row; a document marker without a name gives nothing.
    """
    q = question.strip()
    brand, document = retrieve.BRAND_MARKER in q, any(m in q for m in retrieve.DOCUMENT_MARKERS)
    types = frozenset(t for m, ts in retrieve.TYPE_MARKERS.items() if m in q for t in ts)
    if document and not document_reference(q):
        return Route("none", types)
    if brand or document:
        return Route("scoped", types, (brand_reference(q) or "") if brand else None, document_reference(q) if document else None)
    return Route("overview" if any(p in q for p in retrieve.OVERVIEW) else "plain", types)


def routed(questions: DataFrame, text: str = "question") -> DataFrame:
    """questions with kind, types (sorted), brand, document: route() of each row's text as expressions, null for a brand or document that is not asked for. A null text is plain."""
    q = F.trim(F.coalesce(F.col(text), F.lit("")))
    has = lambda *ms: F.exists(F.array(*map(F.lit, ms)), lambda m: F.contains(q, m))
    before, after, name = F.regexp_extract(q, BRAND_BEFORE, 1), F.regexp_extract(q, BRAND_AFTER, 1), F.regexp_extract(q, DOCUMENT, 1)
    brand = F.when(before != "", before).when(~after.isin(*NO_REFERENCE), after).otherwise("")
    asks_brand, asks_document = F.contains(q, F.lit(retrieve.BRAND_MARKER)), has(*retrieve.DOCUMENT_MARKERS)
    types = F.array_sort(F.array_distinct(F.flatten(F.array(*[F.when(F.contains(q, F.lit(m)), F.array(*map(F.lit, ts))).otherwise(F.array().cast("array<string>")) for m, ts in retrieve.TYPE_MARKERS.items()]))))
    kind = F.when(asks_document & (name == ""), "none").when(asks_brand | asks_document, "scoped").when(has(*retrieve.OVERVIEW), "overview").otherwise("plain")
    scoped = kind == "scoped"
    return questions.withColumns({"kind": kind, "types": types, "brand": F.when(scoped & asks_brand, brand), "document": F.when(scoped & asks_document, name)})


def answered(question: str, entities: DataFrame, relations: DataFrame, statements: DataFrame, documents: DataFrame, k: int = 8) -> DataFrame | None:
    """kind, id for a question by its route; None where it can't be answered. statements: statement_id, statement_text, doc_id, order_index, document_id, subject_id, and created_at where their age counts.

    A scoped question gets the k newest entities of its scope and the k newest statements: of its document, and of a brand those whose subject is the brand's or bears its name.
    """
    to = route(question)
    if to.kind == "none":
        return None
    if to.kind == "plain":
        return retrieve.search(entities, statements, question, k).select("kind", "id")
    if to.kind == "overview":
        some = entities.where(F.col("type").isin(*to.types)) if to.types else entities
        return retrieve.overview(some, relations, statements, k)
    rows = retrieve.scoped(entities, sorted(to.types) or None, to.brand)
    if to.document is not None:
        known = resolved(documents, to.document).first()
        if known is None:
            return None
        rows = in_document(rows, relations, statements, known[0])
        statements = statements.where(F.col("document_id") == known[0])
    if to.brand is not None:
        own = entities.where((F.col("name") == to.brand) | (F.col("brand_id") == to.brand)).select(F.col("id").alias("subject_id")).distinct()
        statements = statements.join(own, "subject_id", "left_semi")
    said = retrieve.newest_statements(statements).limit(k).select(F.lit("statement").alias("kind"), F.col("statement_id").alias("id"))
    return newest(rows, "updated_at", "id", k).select(F.lit("entity").alias("kind"), "id").unionByName(said)


def citations(refs: DataFrame, units: DataFrame, spans: DataFrame, documents: DataFrame, document_id: str | None = None, first: int = 10) -> DataFrame:
    """References resolved to places and titles: item, document_id, title, unit_id, char_start, char_end; of one document if given; the first ones of an item."""
    if document_id is not None:
        refs = refs.where(F.col("doc_id").cast("string") == document_id)
    got = retrieve.citations(refs, units, spans, first)
    titles = documents.select(F.col("document_id").alias("kg_id"), "title")
    return got.join(titles, F.col("doc_id").cast("string") == F.col("kg_id"), "left").select("item", F.col("doc_id").cast("string").alias("document_id"), "title", "unit_id", "char_start", "char_end")


def context(hits: DataFrame, most: int = 12, chars: int = 500) -> DataFrame:
    """One text of numbered hits (position, kind, text), the first ones, each cut to some characters: the context of an answer."""
    rows = hits.orderBy("position").limit(most).select("position", F.concat(F.lit("["), F.col("kind"), F.lit("] "), F.substring("text", 1, chars)).alias("line"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("position", "line"))), lambda x: x["line"])
    return rows.agg(F.array_join(F.transform(lines, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n").alias("context"))


def question_list(message: str, history: list[tuple[str, str]], last: int = 4) -> list[str]:
    """A message and the user's turns among the last history items (role, text), each text once."""
    out = [message]
    for role, text in history[-last:]:
        if role == "user" and text not in out:
            out.append(text)
    return out


def complete_exchanges(messages: DataFrame) -> DataFrame:
    """Chat messages (exchange_id, role) of exchanges that have both a user's and an assistant's row."""
    roles = messages.groupBy("exchange_id").agg(F.count_distinct(F.when(F.col("role").isin("user", "assistant"), F.col("role"))).alias("n"))
    return messages.join(roles.where("n = 2").select("exchange_id"), "exchange_id", "left_semi")


class Api:
    """The HTTP surface's reads over a store of tables (documents, entities, relations, statements, units, spans, jobs)."""

    def __init__(self, store: dict[str, DataFrame]) -> None:
        self.store = store

    def documents(self, k: int = 100) -> DataFrame:
        return newest(self.store["documents"], "updated_at", "document_id", k)

    def document(self, document_id: str) -> DataFrame:
        return by_value(self.store["documents"], "document_id", document_id)

    def graph(self, layer: str | None = None, limit: int = 500) -> DataFrame:
        return graph.view(self.store["entities"], self.store["relations"], max(1, min(limit, 2000)), layer)

    def cited_graph(self, layer: str | None = None, brand: str | None = None, limit: int = 500) -> DataFrame:
        """One JSON text of the graph with citations and stats, as the graph route gives it."""
        s = self.store
        return graph.cited_json(*graph.cited(s["entities"], s["relations"], s["units"], s["spans"], s["documents"], max(1, min(limit, 2000)), layer, brand))

    def entity(self, entity_id: str) -> DataFrame:
        return by_value(self.store["entities"], "id", entity_id)

    def statements(self, document_id: str | None = None, k: int = 100) -> DataFrame:
        rows = self.store["statements"] if document_id is None else by_value(self.store["statements"], "document_id", document_id)
        return retrieve.newest_statements(rows).limit(k)

    def units(self, document_id: str) -> DataFrame:
        return by_value(self.store["units"], "document_id", document_id).orderBy("unit_id")

    def spans(self, document_id: str) -> DataFrame:
        return by_value(self.store["spans"], "document_id", document_id).orderBy("order_index")

    def candidates(self, document_id: str) -> DataFrame:
        return by_value(self.store["candidates"], "document_id", document_id).orderBy("id")

    def jobs(self, k: int = 100) -> DataFrame:
        return newest(self.store["jobs"], "created_at", "id", k)

    def search(self, question: str, k: int = 8) -> DataFrame | None:
        s = self.store
        return answered(question, s["entities"], s["relations"], s["statements"], s["documents"], k)

    def stats(self) -> DataFrame:
        return table_counts(**{n: self.store[n] for n in ("documents", "entities", "relations", "statements") if n in self.store})


def shown(status: Column) -> Column:
    """Whether a job of this status is taken up again after a restart."""
    return status.isin("queued", "running")
