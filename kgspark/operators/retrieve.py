"""Retrieval: plain and scoped search, overview quotas, citations, query merging, nearest vectors, intents."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from kgspark.session import workers_import_this

#: Phrases and markers that decide a question's intent.
OVERVIEW = ("知识库概览", "工作区概览", "知识库中的内容", "数据库中的内容", "工作区内容", "总结当前知识库", "介绍当前知识库", "当前知识库有哪些", "当前工作区有哪些")
TYPE_MARKERS = {"产品": ("product", "solution", "service"), "能力": ("capability", "service"), "功能": ("capability", "service"), "客户": ("customer", "audience"), "用户": ("customer", "audience"), "行业": ("industry", "organization", "audience"), "市场": ("industry", "organization", "audience")}
BRAND_MARKER, DOCUMENT_MARKERS = "品牌", ("文档", "资料", "本文")


@dataclass(frozen=True)
class Intent:
    overview: bool = False
    types: frozenset[str] = field(default_factory=frozenset)
    brand: bool = False
    document: bool = False


def intent(question: str) -> Intent:
    """What a question asks for, from its markers."""
    q = re.sub(r"\s+", "", question)
    types = frozenset(t for m, ts in TYPE_MARKERS.items() if m in q for t in ts)
    return Intent(any(p in q for p in OVERVIEW), types, BRAND_MARKER in q, any(m in q for m in DOCUMENT_MARKERS))


def newest_statements(statements: DataFrame) -> DataFrame:
    """Statements newest first; where they have no created_at, in the order of documents."""
    age = [F.desc("created_at")] if "created_at" in statements.columns else []
    place = [c for c in ("doc_id", "order_index") if c in statements.columns]
    return statements.orderBy(*age, *([] if age else place), "statement_id")


def search(entities: DataFrame, statements: DataFrame, query: str, k: int) -> DataFrame:
    """kind, id, text: the newest k entities whose name or type, and k statements whose text, hold the query in any case."""
    like = f"%{query}%"
    e = entities.where(F.col("name").ilike(like) | F.col("type").ilike(like)).orderBy(F.desc("updated_at"), "id").limit(k)
    s = newest_statements(statements.where(F.col("statement_text").ilike(like))).limit(k)
    return e.select(F.lit("entity").alias("kind"), "id", F.col("name").alias("text")).unionByName(s.select(F.lit("statement").alias("kind"), F.col("statement_id").alias("id"), F.col("statement_text").alias("text")))


def scoped(entities: DataFrame, types: list[str] | None = None, brand: str | None = None) -> DataFrame:
    """Active entities of some types within a brand: its own rows, and the brand of that name."""
    rows = entities.where("status = 'active'")
    if types:
        rows = rows.where(F.col("type").isin(types))
    if brand is not None:
        rows = rows.where((F.col("brand_id") == brand) | ((F.col("type") == "brand") & (F.col("name") == brand)))
    return rows


def overview(entities: DataFrame, relations: DataFrame, statements: DataFrame, k: int) -> DataFrame:
    """Half of k entities, a quarter relations, statements for the rest; kind, id."""
    ne, nr = max(1, k // 2), max(1, k // 4)
    e = entities.where("status = 'active'").orderBy(F.desc("updated_at"), "id").limit(ne).select(F.lit("entity").alias("kind"), "id")
    r = relations.orderBy(F.desc("created_at"), "source_id", "target_id").limit(nr).select(F.lit("relation").alias("kind"), F.concat_ws(">", "source_id", "target_id").alias("id"))
    s = statements.orderBy("doc_id", "order_index").limit(max(0, k - ne - nr)).select(F.lit("statement").alias("kind"), F.col("statement_id").alias("id"))
    return e.unionByName(r).unionByName(s)


def citations(refs: DataFrame, units: DataFrame, spans: DataFrame | None = None, first: int = 10) -> DataFrame:
    """References (item, doc_id, unit_id) resolved to their units' spans: item, doc_id, unit_id, char_start, char_end; the first ones of an item.

    Units that carry their place (char_start, char_end, as parse.units() gives them) need no spans.
    """
    if spans is None:
        places = units.select("doc_id", "unit_id", "char_start", "char_end")
    else:
        wanted = units.join(refs.select("doc_id", "unit_id").distinct(), ["doc_id", "unit_id"], "left_semi").select("doc_id", "unit_id", F.explode("source_span_ids").alias("span_id"))
        places = wanted.join(spans.select("doc_id", "span_id", "char_start", "char_end"), ["doc_id", "span_id"]).groupBy("doc_id", "unit_id").agg(F.min("char_start").alias("char_start"), F.max("char_end").alias("char_end"))
    got = refs.select("item", "doc_id", "unit_id").distinct().join(places, ["doc_id", "unit_id"])
    k = F.row_number().over(Window.partitionBy("item").orderBy("doc_id", "unit_id"))
    return got.withColumn("k", k).where(F.col("k") <= first).drop("k")


def merge_hits(hits: DataFrame, limit: int) -> DataFrame:
    """Hits of several queries (query_no, rank, kind, id): each item once, at its first place, the first ones."""
    best = hits.groupBy("kind", "id").agg(F.min(F.struct("query_no", "rank")).alias("at"))
    return best.orderBy("at.query_no", "at.rank", "kind", "id").limit(limit).select("kind", "id", "at.query_no", "at.rank")


def nearest(vectors: DataFrame, queries: DataFrame, k: int, max_queries: int = 10_000) -> DataFrame:
    """query_id, vec_id, similarity, k: the k nearest vectors of each query by cosine, rounded to six places; of equal ones the lesser ids.

    Queries and vectors are dealt by hashes of their ids into blocks, every two of which meet in one task of bounded size: it multiplies them and keeps each query's
    best k, so nothing goes through the driver and what is ranked at the end is k rows a query and block. A zero vector's similarity is NaN, which counts as greatest; that of a
    null vector, a null element or another length is null, which counts as least.
    """
    workers_import_this(vectors.sparkSession)
    blocks = lambda df, most: -(-df.count() // most) or 1
    nq, nv = blocks(queries, -(-max_queries // 2)), blocks(vectors, VECTORS)
    usable = F.coalesce(~F.exists("embedding", lambda x: x.isNull()), F.lit(False)).alias("usable")
    side = lambda df: df.where("vec_id is not null").select("vec_id", "embedding", usable)
    of = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = side(queries).select("*", of(nq).alias("qb"), every(nv).alias("vb"))
    v = side(vectors).select("*", of(nv).alias("vb"), every(nq).alias("qb"))

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return _best(a, b, k)

    met = q.groupBy("qb", "vb").cogroup(v.groupBy("qb", "vb")).applyInPandas(best, "query_id long, vec_id long, placed double")
    w = Window.partitionBy("query_id").orderBy(F.desc("placed"), "vec_id")
    infinite = F.lit(float("inf"))
    similarity = F.when(F.col("placed") == infinite, float("nan")).when(F.col("placed") != -infinite, F.col("placed"))
    return met.withColumn("k", F.row_number().over(w)).where(F.col("k") <= k).select("query_id", "vec_id", similarity.alias("similarity"), "k")


#: Vectors of a block, and queries that are multiplied with one at a time.
VECTORS, AT_ONCE = 4096, 256


def _best(queries: pd.DataFrame, vectors: pd.DataFrame, k: int) -> pd.DataFrame:
    """Each query's k greatest rounded similarities to the vectors of a block; `placed` ranks them (NaN as infinite, null as minus infinite)."""
    vectors = vectors.sort_values("vec_id", kind="stable")
    ids = vectors["vec_id"].to_numpy(np.int64)
    long = lambda rows: np.array([len(e) if ok else -1 for e, ok in zip(rows["embedding"], rows["usable"])], np.int64)
    lengths, asked = long(vectors), long(queries)
    out = []
    for n in np.unique(asked):
        mine = queries[asked == n]
        fits = np.flatnonzero(lengths == n) if n >= 0 else np.zeros(0, np.int64)
        packed = lambda e: np.array([np.asarray(x, np.float64) for x in e], np.float64).reshape(len(e), max(n, 0))
        m = packed(list(vectors["embedding"].iloc[fits]))
        sizes = np.sqrt((m * m).sum(1))
        for at in range(0, len(mine), AT_ONCE):
            some = mine.iloc[at : at + AT_ONCE]
            rank = np.full((len(some), len(ids)), -np.inf)
            if len(fits):
                x = packed(list(some["embedding"]))
                with np.errstate(invalid="ignore", divide="ignore"):
                    s = (x @ m.T) / (np.sqrt((x * x).sum(1))[:, None] * sizes[None, :])
                s = np.sign(s) * np.floor(np.abs(s) * 1e6 + 0.5) / 1e6
                rank[:, fits] = np.where(np.isnan(s), np.inf, s)
            for q, row in zip(some["vec_id"].to_numpy(np.int64), rank):
                keep = np.flatnonzero(ids != q)
                r = row[keep]
                if len(r) > k:
                    least = np.partition(r, len(r) - k)[len(r) - k]
                    above, equal = np.flatnonzero(r > least), np.flatnonzero(r == least)
                    chosen = np.concatenate([above, equal[: k - len(above)]])
                    keep, r = keep[chosen], r[chosen]
                out.append((np.full(len(r), q), ids[keep], r))
    if not out:
        return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "placed": pd.Series(dtype="float64")})
    q, v, r = (np.concatenate(c) for c in zip(*out))
    return pd.DataFrame({"query_id": q, "vec_id": v, "placed": r})
